"""The corpus pipeline: toxicity, line dedup, near-copy removal, decontamination, packing.

Rows are told apart by id and text, so rows that share an id are judged each by its own text; rows alike in
both are exact copies. Whole rows pass through the stages that judge each document by itself; in the other two they
move once, to meet a narrow table of decisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraud_engine.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from fraud_engine.llm.common import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject."""
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return scored.where("predicted = 0").select(f"{toxicity.CARRIED}.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many documents share."""
    cut = line_dedup.dedup_lines(docs, carry=True)
    # A null text stays null: it has no line to lose.
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("_carried.text"))
    new = {"text": text.alias("text"), "n_chars": F.char_length(text).cast("long").alias("n_chars")}
    return cut.select(*[new.get(c, F.col(f"_carried.`{c}`")) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked as near copies, the one with the smallest id; of exact copies of a row, one."""
    linked = jaccard_join.link_components(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = linked.where("component is not null").groupBy("component").agg(F.min_by("row_key", order).alias("_key"))
    alone = linked.where("component is null").select(F.col("row_key").alias("_key"))
    kept = materialize(first.select("_key").union(alone).distinct(), "kept-rows")
    keyed = docs.select(jaccard_join.row_key().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    number = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    # The kept rows grow with the table, so they are merged at every size.
    staying = keyed.join(kept.hint("merge"), "_key").withColumn("_number", number).where("_number = 1")
    return staying.select("_row.*")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no window of words with the benchmark."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.where("n_hit = 0").select("_carried.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", uncontaminated),
    ("best_fit", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs


# Learned scores and best-fit packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
