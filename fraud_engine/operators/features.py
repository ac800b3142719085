"""Raw transactions to the feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import schema as S
from ..errors import ModelNotFound
from ..session import local_table, materialize
from ..sources import read_or_none
from .behavior import CardMetrics
from .encode import fit_vocabulary, place_flags, value_place
from .lookup import JobLookup, matrix_to_pairs


def drop_unused(txn: DataFrame) -> DataFrame:
    """Without the columns that carry nothing; those not present are ignored."""
    return txn.drop(*S.UNUSED)


def label_first(df: DataFrame) -> DataFrame:
    """The label as first column, the others in their order; unchanged without a label."""
    if S.LABEL not in df.columns:
        return df
    return df.select(S.LABEL, *[c for c in df.columns if c != S.LABEL])


def row_features(txn: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per-row values, narrow: flags come last, so that joins move few columns."""
    label = [S.LABEL] if S.LABEL in txn.columns else []
    extra = [c for c in keep if c not in label]
    if S.ROW_KEY in txn.columns and S.ROW_KEY not in extra:
        extra.append(S.ROW_KEY)
    year = F.year("dob") if dict(txn.dtypes)["dob"] == "date" else fn.birth_year("dob")
    return txn.select(
        *label,
        fn.hour_of_day("trans_date_trans_time").alias("txn_time"),
        "amt",
        fn.comma_to_dash("category").alias("category"),
        "state",
        fn.comma_to_dash("job").alias("job"),
        year.alias("birth_year"),
        fn.haversine_km("lat", "long", "merch_lat", "merch_long").alias("distance"),
        S.CARD,
        *extra,
    )


def decade_flags(year: str = "birth_year") -> list[Column]:
    return [fn.decade_flag(year, start).alias(name) for name, start in S.DECADES.items()]


def decade_place(year: str = "birth_year") -> Column:
    """Place of the birth decade among the flags, from 0; another number outside of them."""
    first = min(S.DECADES.values())
    return F.coalesce(F.floor((F.col(year) - first) / 10), F.lit(-1)).cast("int")


@dataclass(frozen=True)
class FeatureModel:
    """Fitted vocabularies and job lookup. The output columns depend on nothing else."""

    categories: list[str]
    states: list[str]
    job_categories: list[str]
    lookup: JobLookup

    @classmethod
    def fit(
        cls,
        txn: DataFrame,
        lookup: JobLookup,
        categories: list[str] | None = None,
        states: list[str] | None = None,
        job_categories: list[str] | None = None,
    ) -> "FeatureModel":
        """Vocabularies that are not given are learnt from the data."""
        learn = [c for c, given in (("category", categories), ("state", states)) if given is None]
        learnt = {}
        if learn:
            learnt = fit_vocabulary(txn.select(
                fn.comma_to_dash("category").alias("category"), "state"), learn)
        if job_categories is None:
            job_categories = fit_vocabulary(lookup.pairs, ["job_category"])["job_category"]
        return cls(
            categories if categories is not None else learnt["category"],
            states if states is not None else learnt["state"],
            job_categories,
            lookup,
        )

    @classmethod
    def from_matrix(cls, txn: DataFrame, matrix: DataFrame, **vocabularies) -> "FeatureModel":
        """As `fit`, with the lookup in its wide form; job flags follow the matrix's columns."""
        vocabularies.setdefault("job_categories", list(matrix.columns))
        return cls.fit(txn, JobLookup.fit(matrix_to_pairs(matrix)), **vocabularies)

    @property
    def feature_columns(self) -> list[str]:
        return S.feature_columns(self.categories, self.states, self.job_categories)

    @property
    def schema(self):
        return S.feature_schema(self.categories, self.states, self.job_categories)

    def transform(
        self,
        txn: DataFrame,
        fit_on: DataFrame | None = None,
        keep: tuple[str, ...] = (),
        keep_distance: bool = False,
        parse_once: bool = False,
    ) -> DataFrame:
        """The feature table: `keep` columns first, then label and features.

        Card metrics come from `txn` itself, or from `fit_on`, raw transactions to learn
        them from (the training part, say). The input is read for the metrics and for the
        rows; with `parse_once` the narrow rows are stored in between, which pays when the
        input is text.
        """
        rows = row_features(txn, keep)
        if parse_once:
            rows = materialize(rows, "row_features")
        source = rows if fit_on is None else row_features(fit_on)
        rows = CardMetrics.fit(source).attach(self.lookup.attach(rows))
        label = [S.LABEL] if S.LABEL in rows.columns else []
        placed = rows.withColumns({
            "_category": value_place("category", self.categories),
            "_state": value_place("state", self.states),
            "_job": value_place("job_category", self.job_categories),
            "_decade": decade_place(),
        })
        return placed.select(
            *[c for c in keep if c not in label],
            *label,
            "txn_time",
            "amt",
            *place_flags("_category", S.category_columns(self.categories)),
            *place_flags("_state", S.state_columns(self.states)),
            *place_flags("_job", S.job_columns(self.job_categories)),
            *place_flags("_decade", list(S.DECADES), 0),
            *(["distance"] if keep_distance else []),
            *S.CARD_METRICS,
        )

    def save(self, path: str) -> None:
        """Two small tables: the vocabularies in order, and the lookup pairs."""
        spark = self.lookup.pairs.sparkSession
        rows = [
            (name, i, value)
            for name, values in (("category", self.categories), ("state", self.states),
                                 ("job_category", self.job_categories))
            for i, value in enumerate(values)
        ]
        (local_table(spark, rows, "column string, position int, value string")
         .write.mode("overwrite").parquet(f"{path}/vocabulary"))
        self.lookup.pairs.write.mode("overwrite").parquet(f"{path}/job_lookup")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureModel":
        vocabulary = read_or_none(spark.read.parquet, f"{path}/vocabulary")
        if vocabulary is None:
            raise ModelNotFound(f"no stored feature model under {path}")
        stored = vocabulary.orderBy("column", "position").collect()
        values = {c: [r["value"] for r in stored if r["column"] == c]
                  for c in ("category", "state", "job_category")}
        return cls(values["category"], values["state"], values["job_category"],
                   JobLookup.fit(spark.read.parquet(f"{path}/job_lookup")))
