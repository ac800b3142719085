"""Line deduplication over levelled sorted runs of line hashes; DataFrame functions only.

`LineRuns` holds what earlier batches brought: runs of line hashes, each bucketed and sorted by hash
and holding a hash that no other run holds. A new batch merge-anti-joins every run; what is left is
new and becomes a run of its own, and what the runs already hold becomes a small table of further
counts. A level that has `fanout` runs is merged into one run of the next level, so a batch meets few
runs however many batches there were. Runs and batch share their buckets, so the joins move nothing.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys are compared by
two 64-bit hashes. Rows equal in id and text are one document; a null or empty text is one empty line;
rows with one id and different texts are different documents, and a line stays in all of them where
that id is the largest. A null id is smaller than all others.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, materialize, parts_for, run_folder

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3
#: Spark allows 100,000 buckets; beyond this number buckets hold more lines, sorted as ever.
MOST_BUCKETS = 50_000
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, last_doc) in levels, in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, min(buckets, MOST_BUCKETS), fanout
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []
        self.names: list[str] = []

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"line_run_{uuid4().hex}"
        self.names.append(name)
        (run.repartition(self.buckets, *_KEY).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
         .option("path", f"{run_folder(self.spark)}/{name}").saveAsTable(name))
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in (h1, h2, doc_id), one row for each line and document; return the new run."""
        own = batch.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if self.runs():
            own = self._write(own)  # read once for each run
            new = reduce(lambda left, run: left.join(run, _KEY, "left_anti"), self.runs(), own)
            new = self._write(new)
            known = own.join(new, _KEY, "left_anti")
            self.repeats.append(materialize(known, "line-repeats"))
        else:
            new = self._write(own)
        self._place(new, 0)
        return new

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._write(reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            self._place(merged, level + 1)

    def close(self) -> None:
        """Take the runs out of the session's catalog; their files go with the application."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, last_doc) of every line of every batch."""
        if not self.repeats:
            return reduce(DataFrame.unionByName, self.runs())
        further = (
            reduce(DataFrame.unionByName, self.repeats).groupBy(*_KEY)
            .agg(F.sum("n_docs").alias("more_docs"), F.max("last_doc").alias("later_doc")))
        return reduce(DataFrame.unionByName, [
            run.join(further, _KEY, "left").select(
                *_KEY, (F.col("n_docs") + F.coalesce("more_docs", F.lit(0))).alias("n_docs"),
                F.greatest("last_doc", "later_doc").alias("last_doc"))
            for run in self.runs()])


def line_key(line):
    """ASCII space stripped at both ends, A-Z lower-cased."""
    trimmed = F.trim(line, F.lit(_SPACE))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, upper, lower))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, pos, h1, h2 of each line whose key has `min_chars` code points."""
    return (
        docs.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit(1), "key").alias("h2")))


_CARRIED = "_carried"


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                batches: int = BATCHES, fanout: int = FANOUT, carry: bool = False) -> DataFrame:
    """doc_id, text_key, text, n_lines, n_dropped, kept of every document, with `carry` the whole row as `_carried`.

    Lines whose key has at least `min_chars` code points and is found in at least `min_docs` documents
    go, except in the document with the largest id that holds the key. Whole texts move once, to meet the numbers of
    their dropped lines.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_CARRIED)] if carry else []
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row,
    ).withColumn("text_key", F.xxhash64("text"))
    spark = docs.sparkSession
    buckets = parts_for(keyed, least=2)
    batch = F.pmod(F.xxhash64("text_key", "doc_id"), F.lit(batches))
    lines = materialize(long_lines(keyed, min_chars), "lines")
    runs = LineRuns(spark, buckets, fanout)
    try:
        for k in range(batches):
            runs.add(lines.where(batch == k).select("doc_id", "text_key", *_KEY).distinct())
        repeated = runs.totals().where(F.col("n_docs") >= min_docs).select(*_KEY, "last_doc")
        dropped = (
            lines.join(repeated, _KEY).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
            .groupBy("doc_id", "text_key").agg(F.collect_list("pos").alias("gone")).withColumnRenamed("doc_id", "_id")
            .withColumnRenamed("text_key", "_text_key"))
        dropped = materialize(dropped.withColumn("gone", F.array_distinct("gone")), "dropped-lines")
    finally:
        runs.close()
    # The list of dropped lines grows with the table, so it is merged at every size.
    found = keyed.join(
        dropped.hint("merge"), (F.col("text_key") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    parts = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    return found.select(
        "doc_id", "text_key", "text", F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"), *([_CARRIED] if carry else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, how many of them were dropped, and a digest of what is left."""
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
