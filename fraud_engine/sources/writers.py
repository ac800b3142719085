"""Writers. Every one keeps the partitions that Spark has; none funnels rows into one task."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def output_name(input_path: str, fmt: str = "csv") -> str:
    """`Processed_` plus the file name of the input, with the ending of the output format."""
    stem = os.path.splitext(os.path.basename(input_path.rstrip("/")))[0]
    return f"Processed_{stem}.{fmt}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Overwrite `path` with `df` as Parquet, or as CSV with a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_flagged(flagged: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write flagged rows sorted by probability; the files follow that order.

    Equal probabilities are in order of the row key, or of a hash of the row where there is none, so
    they need not meet in one range partition.
    """
    key = S.ROW_KEY in flagged.columns
    tie = F.col(S.ROW_KEY) if key else F.xxhash64(*[F.col(f"`{c}`") for c in flagged.columns])
    return write_table(flagged.orderBy(F.desc("fraud_probability"), tie), path, fmt)
