"""What the operators share on the Spark side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraud_engine.session import materialize, run_folder  # noqa: F401

# Bytes of text that one group or partition of work is meant to hold.
PART_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns the operators need, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def parts_for(docs: DataFrame, part_bytes: int = PART_BYTES, least: int = 1) -> int:
    """Parts of about `part_bytes` of text, from the bytes that the table holds."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-int(total) // part_bytes))
