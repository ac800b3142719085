"""Left join to a lookup with one row per key, safe for large lookups and hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_PARTS of all rows, so fewer than HOT_PARTS keys
# can be hot and their slices add up to less than 2 * HOT_PARTS.
HOT_PARTS = 2000


def hot_keys(counts: DataFrame, key: str, n: str = "n", parts: int = HOT_PARTS) -> DataFrame:
    """(key, slices) of the hot keys; fewer than `parts` rows, whatever the data."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return (
        counts.where(F.col(key).isNotNull() & (F.col(n) * parts > F.lit(total)))
        .select(key, F.ceil(F.col(n) * parts / F.lit(max(total, 1))).cast("int").alias("_slices"))
    )


def left_lookup(fact: DataFrame, dim: DataFrame, key: str, slice_hot: bool = False, parts: int = HOT_PARTS) -> DataFrame:
    """`fact` LEFT JOIN `dim` on `key`; `dim` is a small or a stored table, so its size is known.

    Spark chooses the way from that size, and splits skewed partitions. With `slice_hot`, for sessions
    that cannot split them, rows of hot keys are spread over slices first and `dim` holds one copy of
    theirs per slice; the hot keys are those of `fact`, the rows that are moved. Give `fact` with
    its row identifier then: slices come from a hash of the row.
    """
    if not slice_hot:
        return fact.join(dim, key, "left")
    counts = fact.groupBy(key).agg(F.count("*").alias("n"))
    hot = F.broadcast(hot_keys(counts, key, parts=parts))
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in fact.columns])
    # A null key finds nothing, so its rows may go to any slice.
    slices = F.when(F.col(key).isNull(), parts).otherwise(F.coalesce("_slices", F.lit(1)))
    sliced_fact = (
        fact.join(hot, key, "left").withColumn("_slice", F.pmod(row_hash, slices).cast("int"))
        .drop("_slices")
    )
    sliced_dim = (
        dim.join(hot, key, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
        .drop("_slices")
    )
    return sliced_fact.join(sliced_dim, [key, "_slice"], "left").drop("_slice")
