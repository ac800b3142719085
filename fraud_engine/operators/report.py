"""The fraud pattern report and the tables behind its charts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import schema as S
from ..session import run_folder
from .ranking import SLICE_ROWS

PAGE_SIZE = 6


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def _quoted(c: str) -> Column:
    return F.col(f"`{c}`")


def _fraud() -> Column:
    return F.col(S.LABEL) == 1


def _normal() -> Column:
    return F.col(S.LABEL) == 0


def _fraud_sum(c: str) -> Column:
    return F.coalesce(F.sum(F.when(_fraud(), _quoted(c))), F.lit(0)).cast("long")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def flag_counts(features: DataFrame, prefix: str, top: int | None = None) -> DataFrame:
    """(category, n): fraud rows per one-hot column, most first, names breaking ties."""
    names = columns_with_prefix(features, prefix)
    sums = features.agg(*[_fraud_sum(c).alias(c) for c in names])
    ranked = sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), _quoted(c).alias("n")) for c in names
    ]))).orderBy(F.desc("n"), "category")
    return ranked if top is None else ranked.limit(top)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """The same ranking on a column that is not one-hot encoded."""
    counts = (
        df.where(_fraud() & F.col(column).isNotNull())
        .groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "category")
    )
    return counts if top is None else counts.limit(top)


def _mean_of(column: str) -> tuple[Column, Column]:
    return F.avg(F.when(_fraud(), F.col(column))), F.avg(F.when(_normal(), F.col(column)))


def amount_analysis(df: DataFrame) -> DataFrame:
    fraud, normal = _mean_of("amt")
    return df.agg(fraud.alias("fraud_avg"), normal.alias("normal_avg")).withColumn(
        "increase_pct", fn.percent_change("fraud_avg", "normal_avg"))


def time_analysis(df: DataFrame) -> DataFrame:
    fraud, normal = _mean_of("txn_time")
    return df.agg(fraud.alias("fraud_avg_hour"), normal.alias("normal_avg_hour"))


def category_share(counts: DataFrame) -> DataFrame:
    """`counts` (category, n), one row per category, with the percentage of the total."""
    return counts.withColumn(
        "share_pct", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy())) * 100)


def category_vs_max(counts: DataFrame) -> DataFrame:
    """`counts` (category, n) with the part of the largest count."""
    return counts.withColumn(
        "vs_max", F.try_divide(F.col("n"), F.max("n").over(Window.partitionBy())))


def labelled(counts: DataFrame, prefix: str, upper: bool = False) -> DataFrame:
    """`counts` with names as a chart shows them."""
    return counts.withColumn("label", fn.display_label("category", prefix, upper))


def _counts_map(names: list[str], top: int | None = None) -> Column:
    """Counts of one aggregate row as a map, the highest `top` of them."""
    ranked = F.array_sort(F.array(*[
        F.struct((-_quoted(c)).alias("order"), F.lit(c).alias("name")) for c in names]))
    if top is not None:
        ranked = F.slice(ranked, 1, top)
    return F.map_from_entries(F.transform(ranked, lambda r: F.struct(r["name"], -r["order"])))


def pattern_report(scored: DataFrame, prediction: str = "is_fraud_predicted") -> DataFrame:
    """One row with the six sections, from one pass over features, label and prediction."""
    jobs = columns_with_prefix(scored, S.JOB_PREFIX)
    categories = columns_with_prefix(scored, S.CATEGORY_PREFIX)
    decades = columns_with_prefix(scored, S.DECADE_PREFIX)
    amount, hour = _mean_of("amt"), _mean_of("txn_time")
    totals = scored.agg(
        *[_fraud_sum(c).alias(c) for c in [*jobs, *categories, *decades]],
        amount[0].alias("fraud_avg"), amount[1].alias("normal_avg"),
        hour[0].alias("fraud_avg_hour"), hour[1].alias("normal_avg_hour"),
        F.coalesce(F.sum(prediction), F.lit(0)).cast("long").alias("fraud_detected"),
        F.count("*").alias("total_transactions"),
    )
    return totals.select(
        _counts_map(jobs, 5).alias("job_categories"),
        _counts_map(categories, 5).alias("transaction_categories"),
        _counts_map(decades).alias("age_groups"),
        F.struct("fraud_avg", "normal_avg",
                 fn.percent_change("fraud_avg", "normal_avg").alias("increase_pct"),
                 ).alias("amount_analysis"),
        F.struct("fraud_avg_hour", "normal_avg_hour").alias("time_analysis"),
        F.struct("fraud_detected", "total_transactions",
                 F.try_divide("fraud_detected", "total_transactions").alias("detection_rate"),
                 ).alias("model_performance"),
    )


def write_report(report: DataFrame, path: str) -> str:
    report.write.mode("overwrite").json(path)
    return path


def page(df: DataFrame, number: int, order: list[Column | str], size: int = PAGE_SIZE) -> DataFrame:
    """Page `number`, from 0, of the rows in this order."""
    return df.orderBy(*order).offset(number * size).limit(size)


@dataclass(frozen=True)
class PageIndex:
    """Rows stored in order by ranges, with the rank at which each range begins; a page reads the ranges it lies in.

    `order` must be unique, so that every row has one rank; null and NaN have places as any order gives them.
    """

    path: str
    order: list[Column | str]
    schema: T.StructType
    spark: SparkSession

    @classmethod
    def build(cls, df: DataFrame, order: list[Column | str], path: str | None = None, slice_rows: int = SLICE_ROWS) -> PageIndex:
        spark = df.sparkSession
        path = path or f"{run_folder(spark)}/pages-{uuid4().hex}"
        cut = df.repartitionByRange(max(math.ceil(df.count() / slice_rows), 1), *order).withColumn("_slice", F.spark_partition_id())
        cut.write.mode("overwrite").partitionBy("_slice").parquet(f"{path}/rows")
        stored = spark.read.schema(cut.schema).parquet(f"{path}/rows")
        above = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        # One row for each range; the window runs over these.
        stored.groupBy("_slice").agg(F.count("*").alias("n")).withColumn(
            "first", F.coalesce(F.sum("n").over(above), F.lit(0))).write.mode("overwrite").parquet(f"{path}/ranges")
        return cls(path, order, cut.schema, spark)

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """Page `number`, from 0, in order."""
        first, last = number * size, (number + 1) * size
        ranges = self.spark.read.parquet(f"{self.path}/ranges").where((F.col("first") < last) & (F.col("first") + F.col("n") > first))
        # As many ranges as a page touches: one, or two at an edge, unless a page is longer than a range.
        begins = {r["_slice"]: r["first"] for r in ranges.collect()}
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        if not begins:
            return rows.drop("_slice").limit(0)
        inside = rows.where(F.col("_slice").isin(list(begins)))
        rank = F.row_number().over(Window.partitionBy("_slice").orderBy(*self.order)) - 1
        start = F.element_at(F.create_map(*[F.lit(v) for pair in begins.items() for v in pair]), F.col("_slice"))
        return inside.withColumn("_rank", rank + start).where(
            (F.col("_rank") >= first) & (F.col("_rank") < last)).orderBy("_rank").drop("_rank", "_slice")


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(
        "n", F.ceil(F.col("n") / size).cast("long").alias("pages"))
