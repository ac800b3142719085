"""Per-card behaviour: aggregates, and their join back to the transactions."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import delete_folder, folders_in, materialize, run_folder
from .joins import HOT_PARTS, left_lookup


def _two_places(value: Column) -> Column:
    """Half up to two places.

    The order of additions shows in the last digits of a sum. Rounding these off first keeps a
    mean that lies between two cents, 45.005 say, from going either way with the partitions.
    """
    return F.round(F.round(value, 9), 2)


def _aggregates() -> list[Column]:
    return [
        _two_places(F.avg("amt")).alias("avg_txn_amt"),
        _two_places(F.stddev_samp("amt")).alias("stddev_txn_amt"),
        _two_places(F.avg("txn_time")).alias("avg_txn_time"),
        _two_places(F.avg("distance")).alias("avg_merchant_distance"),
    ]


def card_metrics(rows: DataFrame) -> DataFrame:
    """One row per card from `amt`, `txn_time` and `distance`, rounded to two places.

    Counts and moments combine before the shuffle, so a card of any size is cheap.
    """
    return rows.groupBy(S.CARD).agg(*_aggregates())


@dataclass(frozen=True)
class CardMetrics:
    """Stored card metrics."""

    table: DataFrame

    @classmethod
    def fit(cls, rows: DataFrame) -> "CardMetrics":
        return cls(materialize(card_metrics(rows), "card_metrics"))

    def attach(self, txn: DataFrame, slice_hot: bool = False, parts: int = HOT_PARTS) -> DataFrame:
        """`txn` with the metrics of its card; see `left_lookup`."""
        return left_lookup(txn, self.table, S.CARD, slice_hot, parts)


# What the moments are kept of.
_MEASURED = ("amt", "txn_time", "distance")
# The key they are stored by: the card, 0 and a mark for the null one, so that plain equality and buckets serve it.
_KEY = ("card", "no_card")


def _moments(rows: DataFrame) -> DataFrame:
    """One row per card: of each measure the number of values, their mean and the sum of squared distances from it."""
    card = F.col(S.CARD).cast("long")
    keyed = rows.select(F.coalesce(card, F.lit(0)).alias("card"), card.isNull().alias("no_card"), *_MEASURED)
    return keyed.groupBy(*_KEY).agg(*[
        F.struct(F.count(c).alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"),
                 F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias("m2")).alias(c) for c in _MEASURED])


def _joined(a: Column, b: Column) -> Column:
    """The moments of two sets of values together (Chan, Golub and LeVeque 1979)."""
    n = a["n"] + b["n"]
    step = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"), (a["mean"] + step * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n).alias("m2"))
    return F.when(a.isNull() | (a["n"] == 0), b).when(b.isNull() | (b["n"] == 0), a).otherwise(both)


class CardMoments:
    """Moments per card, stored in buckets of the card and brought up to date log by log.

    A new log is added up once, and its cards are merged into the stored ones bucket by bucket; logs that are in are
    never read again. A version is complete or not there: a fold that breaks off leaves the last one valid, and can be
    repeated. The null card is a card.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets, self._names = spark, buckets, []
        self.path = path or f"{run_folder(spark)}/moments-{uuid4().hex}"

    def _version(self) -> int:
        whole = [p.rsplit("/", 1)[-1] for p in folders_in(self.spark, self.path, "_SUCCESS")]
        return max((int(p.removeprefix("v")) for p in whole if p.startswith("v")), default=0)

    def _stored(self, version: int) -> DataFrame:
        """The table of a version, known to Spark as bucketed and sorted by card."""
        name = f"card_moments_{uuid4().hex}"
        keys = ", ".join(_KEY)
        schema = ", ".join(["card BIGINT, no_card BOOLEAN", *(f"{c} STRUCT<n: BIGINT, mean: DOUBLE, m2: DOUBLE>" for c in _MEASURED)])
        self.spark.sql(
            f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}/v{version}'")
        self._names.append(name)
        return self.spark.table(name)

    def table(self) -> DataFrame:
        """cc_num and for each measure n, mean, m2 of all logs so far."""
        stored = self.spark.read.parquet(f"{self.path}/v{self._version()}")
        return stored.select(F.when(~F.col("no_card"), F.col("card")).alias(S.CARD), *_MEASURED)

    def fold(self, rows: DataFrame) -> "CardMoments":
        """Take in the rows of a new log: cc_num, amt, txn_time, distance."""
        version, new = self._version(), _moments(rows)
        if version:
            old = self._stored(version).select(*_KEY, *[F.col(c).alias(f"old_{c}") for c in _MEASURED])
            new = old.join(new.repartition(self.buckets, *_KEY), list(_KEY), "full").select(
                *_KEY, *[_joined(F.col(f"old_{c}"), F.col(c)).alias(c) for c in _MEASURED])
        delete_folder(self.spark, f"{self.path}/v{version + 1}")  # of a fold that broke off
        name = f"card_moments_{uuid4().hex}"
        self._names.append(name)
        try:
            # The joined rows are dealt by the key already, so this moves a first log only.
            (new.repartition(self.buckets, *_KEY).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
             .option("path", f"{self.path}/v{version + 1}").saveAsTable(name))
        finally:
            for name in self._names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._names = []
        if version:
            delete_folder(self.spark, f"{self.path}/v{version}")
        return self

    def metrics(self) -> DataFrame:
        """One row per card, as `card_metrics` gives it for all logs together."""
        spread = F.when(F.col("amt.n") > 1, F.sqrt(F.col("amt.m2") / (F.col("amt.n") - 1)))
        known = lambda c: F.when(F.col(f"{c}.n") > 0, F.col(f"{c}.mean"))
        return self.table().select(
            S.CARD, _two_places(known("amt")).alias("avg_txn_amt"), _two_places(spread).alias("stddev_txn_amt"),
            _two_places(known("txn_time")).alias("avg_txn_time"), _two_places(known("distance")).alias("avg_merchant_distance"))
