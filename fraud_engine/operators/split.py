"""Stratified, repeatable splits by a hash of the row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import local_table

HASH_DIGITS = 8
PREFIX_DIGITS = 4

TWO_WAY = {"test": 0.3}
THREE_WAY = {"test": 0.2, "validation": 0.2}


def row_hash(key: str = S.ROW_KEY, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


def hash_cut(fraction: float) -> str:
    """The hex text below which this share of all hashes lies."""
    return format(int(fraction * 16**HASH_DIGITS), f"0{HASH_DIGITS}x")


def hash_split(df: DataFrame, parts: dict[str, float] = THREE_WAY, rest: str = "train",
               key: str = S.ROW_KEY, seed: int = 42) -> DataFrame:
    """`df` with `split`; shares are met up to chance, in every class, without a shuffle."""
    head = F.substring(row_hash(key, seed), 1, HASH_DIGITS)
    split, upto = F.lit(rest), 0.0
    cuts = []
    for name, share in parts.items():
        upto += share
        cuts.append((name, hash_cut(upto)))
    for name, cut in reversed(cuts):
        split = F.when(head < cut, name).otherwise(split)
    return df.withColumn("split", split)


def exact_split(df: DataFrame, parts: dict[str, float] = THREE_WAY, rest: str = "train",
                key: str = S.ROW_KEY, label: str = S.LABEL, seed: int = 42,
                ranked_rows: int = 100_000) -> DataFrame:
    """`df` with `split`, every class cut at round(share * class size), `key` being unique.

    The rows are ordered by hash within their class. The boundary between two parts is found
    by counting hash prefixes, longer ones until at most `ranked_rows` rows have the boundary's, and
    ranking those; the wide rows are then compared with the boundary and never shuffled.
    """
    hashed = df.select(F.col(label).alias("label"), row_hash(key, seed).alias("h"))
    sizes = {r["label"]: r["n"] for r in hashed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    kind = df.schema[label].dataType.simpleString()
    places = []  # (label, part, prefix, rows of that prefix up to the boundary)
    for value, n in sizes.items():
        upto = 0.0
        for name, share in parts.items():
            upto += share
            places.append((value, name, "", int(n * upto + 0.5)))
    places = [p for p in places if p[3] > 0 and p[0] is not None]
    rows = max(sizes.values(), default=0)
    digits = 0
    # Each round counts the next digits of the hash below the boundary's prefix.
    while rows > ranked_rows and digits < 32:
        digits += PREFIX_DIGITS
        wanted = F.broadcast(local_table(df.sparkSession, places, f"label {kind}, part string, within string, place long"))
        counted = (
            hashed.join(wanted, (hashed.label == wanted.label) & F.col("h").startswith(F.col("within"))).drop(wanted.label)
            .groupBy("label", "part", "place", F.substring("h", 1, digits).alias("prefix")).agg(F.count("*").alias("n")))
        # At most 16^PREFIX_DIGITS rows per class and part.
        order = Window.partitionBy("label", "part").orderBy("prefix")
        found = counted.withColumn("before", F.sum("n").over(order) - F.col("n")).where(
            (F.col("before") < F.col("place")) & (F.col("place") <= F.col("before") + F.col("n"))).collect()
        places = [(r["label"], r["part"], r["prefix"], r["place"] - r["before"]) for r in found]
        rows = max((r["n"] for r in found), default=0)
    boundary = F.broadcast(local_table(df.sparkSession, places, f"label {kind}, part string, within string, place long"))
    in_prefix = Window.partitionBy("label", "part").orderBy("h")
    last = (
        hashed.join(boundary, (hashed.label == boundary.label) & F.col("h").startswith(F.col("within"))).drop(boundary.label)
        .withColumn("rank", F.row_number().over(in_prefix)).where(F.col("rank") == F.col("place"))
        .select("label", "part", "h").collect()
    )
    cut = {(r["label"], r["part"]): r["h"] for r in last}
    h, split = row_hash(key, seed), F.lit(rest)
    for value in sizes:
        for name in reversed(parts):
            if (value, name) in cut:
                inside = F.col(label).eqNullSafe(F.lit(value)) & (h <= cut[(value, name)])
                split = F.when(inside, name).otherwise(split)
    return df.withColumn("split", split)


def split_rates(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Rows and label rate per split."""
    return df.groupBy("split").agg(
        F.count("*").alias("n"), F.avg(label).alias("fraud_rate"))


def label_rate(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(label).alias("fraud_rate"))


def class_ratio(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Negatives per positive; null without positives."""
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        negatives.alias("negatives"), positives.alias("positives"),
        F.try_divide(negatives, positives).alias("ratio"))
