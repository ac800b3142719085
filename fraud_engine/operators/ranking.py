"""Exact global orderings without a one-task window: running totals, ranks and percentiles."""

from __future__ import annotations

import math
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import folders_in, materialize

# One slice of a global ordering is one window partition of about this many rows.
SLICE_ROWS = 200_000

_EARLIER = (Window.unboundedPreceding, -1)


def in_slices(values: DataFrame, order: list[Column | str], rows: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """`values` with `_slice`, stored: ranges of `order` of about `slice_rows` rows, numbered in order.

    `rows` counts `values`. The cut points decide how even the slices are, never a result.
    """
    cut = values.repartitionByRange(max(math.ceil(rows / slice_rows), 1), *order)
    return materialize(cut.withColumn("_slice", F.spark_partition_id()), "slices")


def running_totals(
    values: DataFrame,
    order_by: str,
    sums: list[str],
    rows: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """`values` plus `cum_<c>`: sums of `c` over all rows with `order_by` as high or higher.

    `order_by` is unique, not null and not NaN. A slice adds the total of the slices above to its
    own running sum.
    """
    sliced = in_slices(values, [F.desc(order_by)], rows, slice_rows)
    above = Window.orderBy("_slice").rowsBetween(*_EARLIER)
    offsets = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_{c}") for c in sums]).select(
        "_slice", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    within = (
        Window.partitionBy("_slice").orderBy(F.desc(order_by))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return sliced.join(offsets, "_slice").select(
        *values.columns,
        *[(F.sum(c).over(within) + F.col(f"_{c}")).alias(f"cum_{c}") for c in sums],
    )


def places_within(
    values: DataFrame,
    by: str,
    order: str,
    rows: int,
    weight: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """`values` plus `before` and `total`: rows of the same `by` that come earlier in `order`, and all.

    With `weight` a row counts as so many. `by` is not null. Groups are cut into slices as well, so
    none of them has to fit a task.
    """
    n = F.col(weight) if weight else F.lit(1)
    sliced = in_slices(values, [by, order], rows, slice_rows)
    whole = Window.partitionBy(by)
    earlier = whole.orderBy("_slice").rowsBetween(*_EARLIER)
    offsets = sliced.groupBy(by, "_slice").agg(F.sum(n).alias("_n")).select(
        by, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("total"))
    within = Window.partitionBy(by, "_slice").orderBy(order).rowsBetween(*_EARLIER)
    return sliced.join(offsets, [by, "_slice"]).select(
        *values.columns, (F.col("_before") + F.coalesce(F.sum(n).over(within), F.lit(0))).alias("before"), "total")


def store_counts(df: DataFrame, by: str, counts: dict, name: str) -> tuple[DataFrame, int, dict]:
    """Group by a number, store the groups, and return them with their number and totals.

    Rows whose number is null or NaN are left out.
    """
    stored = materialize(
        df.where(F.col(by).isNotNull() & ~F.isnan(F.col(by).cast("double")))
        .groupBy(by).agg(*[e.alias(c) for c, e in counts.items()]),
        name,
    )
    row = stored.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in counts]).first()
    return stored, row[0], dict(zip(counts, row[1:]))


def exact_percentiles(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    group: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Percentiles with linear interpolation, per group of a column if one is given.

    Columns: the group (if any), `probability`, `value`. Same numbers as the `percentile`
    aggregate, which holds all distinct values of a group in one task. Here equal values are
    counted first, and each distinct value gets its rank by range slices, so the work is the same
    for any values and any number of groups, and nothing goes to the driver. Null and NaN values
    and the null group are left out; infinite values count like others.
    """
    g = F.col(group) if group else F.lit(0)
    v = F.col(value).cast("double")
    counts, rows = _value_counts(df, g, v)
    placed = places_within(counts, "_g", "_v", rows, "n", slice_rows)
    at, picked = [], []
    for i, p in enumerate(probabilities):
        place = (F.col("total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
            picked.append(F.max(F.when(inside, F.col("_v"))).alias(f"{side}{i}"))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        share = (F.col("total") - 1) * F.lit(float(p)) - F.floor((F.col("total") - 1) * F.lit(float(p)))
        at.append(F.struct(
            F.lit(float(p)).alias("probability"), F.when(lo == hi, lo).otherwise(lo + (hi - lo) * share).alias("value")))
    found = placed.groupBy("_g", "total").agg(*picked).select("_g", F.inline(F.array(*at)))
    if group is None:
        return found.drop("_g")
    return found.withColumnRenamed("_g", group)


def _value_counts(df: DataFrame, g: Column, v: Column) -> tuple[DataFrame, int]:
    """(_g, _v, n) of the values that are numbers, stored, and how many there are."""
    known = df.select(g.alias("_g"), v.alias("_v")).where(
        F.col("_g").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    stored = materialize(known.groupBy("_g", "_v").agg(F.count("*").alias("n")), "value_counts")
    return stored, stored.count()


class QuantileSketches:
    """Quantile sketches (KLL) of a value by groups, stored part by part and merged when asked.

    A part is a log, a day, a file: it is sketched once, and any later question reads sketches only. Folding a part
    again replaces it. With at most `k` values in a group answers are exact; beyond it a rank is off by about
    2.3 / k^0.9 of the group's rows (0.17 % for the default) with 99 % confidence. For cuts that must be exact there
    is `exact_percentiles`. Null and NaN values are left out; the null group is a group.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str], k: int = 4096):
        self.spark, self.path, self.by, self.k = spark, path, by, k

    def fold(self, part: str, df: DataFrame, value: str) -> "QuantileSketches":
        """Sketch the values of `df`, which must hold the columns `by`, as the part of this name."""
        v = F.col(value).cast("double")
        sketched = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*self.by).agg(F.kll_sketch_agg_double(v, F.lit(self.k)).alias("_sketch"))
        sketched.write.mode("overwrite").parquet(f"{self.path}/{quote(part, safe='')}")
        return self

    def _merged(self, by: list[str]) -> DataFrame:
        parts = [p for p in folders_in(self.spark, self.path, "_SUCCESS")]
        return self.spark.read.parquet(*parts).groupBy(*by).agg(F.kll_merge_agg_double("_sketch").alias("_sketch"))

    def quantiles(self, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
        """The groups (all columns `by`, or fewer of them), `n`, `probability`, `value`: the value of rank ceil(probability * n)."""
        by = self.by if by is None else by
        asked = F.array(*[F.lit(float(p)) for p in probabilities])
        found = self._merged(by).select(
            *by, F.kll_sketch_get_n_double("_sketch").alias("n"),
            F.arrays_zip(asked.alias("probability"), F.kll_sketch_get_quantile_double("_sketch", asked).alias("value")).alias("_points"))
        return found.select(*by, "n", F.inline("_points").alias("probability", "value"))

    def rank_of(self, value: float, by: list[str] | None = None) -> DataFrame:
        """The groups and `rank`, the share of a group's values up to `value`."""
        by = self.by if by is None else by
        return self._merged(by).select(*by, F.kll_sketch_get_rank_double("_sketch", F.lit(float(value))).alias("rank"))
