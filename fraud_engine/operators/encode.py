"""Vocabularies and one-hot flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of all non-null values, for all columns in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return (
        df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
        .where(F.col("value").isNotNull()).distinct()
    )


def fit_vocabulary(df: DataFrame, columns: list[str], max_values: int | None = None) -> dict[str, list[str]]:
    """Sorted distinct values per column, each of which becomes a column of the table.

    With `max_values`, a column that has more is an error.
    """
    vocabulary: dict[str, list[str]] = {c: [] for c in columns}
    for row in distinct_values(df, columns).toLocalIterator():
        vocabulary[row["column"]].append(row["value"])
        if max_values is not None and len(vocabulary[row["column"]]) > max_values:
            raise ValueError(f"column {row['column']} has more than {max_values} distinct values")
    return {c: sorted(v) for c, v in vocabulary.items()}


def value_place(column: str, values: list[str]) -> Column:
    """1-based place of the value in the vocabulary; 0 for null and unknown values."""
    if not values:
        return F.lit(0)
    # A constant map is hashed once, so a look-up does not walk the vocabulary.
    places = F.create_map(*[v for i, value in enumerate(values, 1) for v in (F.lit(value), F.lit(i))])
    return F.coalesce(F.try_element_at(places, F.col(column)), F.lit(0))


def place_flags(place: str, names: list[str], first: int = 1) -> list[Column]:
    """One 0/1 flag per place.

    The text is looked up once for all flags; a flag compares two small integers.
    """
    return [(F.col(place) == i).cast("int").alias(n) for i, n in enumerate(names, first)]


def one_hot(df: DataFrame, column: str, values: list[str], names: list[str]) -> DataFrame:
    """`df` with one 0/1 flag per known value; null and unknown values give 0 everywhere."""
    place = f"_{column}_place"
    placed = df.withColumn(place, value_place(column, values))
    return placed.select(*df.columns, *place_flags(place, names))
