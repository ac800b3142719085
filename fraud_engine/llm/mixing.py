"""Mixing sources to target weights: certain whole copies, then Pareto order sampling.

`source_targets` shares a budget of words out by weight; no target is above `most` times its source, and the
excess goes to the others by weight. `mix` turns targets into copies. A document's expected copies are its
weight times a factor of its source, at most `most`; the factor makes the expected words of the source its
target. The whole part is allocated for certain. The rest is an inclusion chance p for one more copy, settled
by Pareto order sampling: with u a repeatable number of the document, documents are ranked by
u/(1-u) : p/(1-p), smallest first, and the sample is the first ones. Its size is fixed in words: a document is in
it if the middle of its words comes before the words that are left to the target, so a source misses
its target by less than half a document.

Where the sample ends is found without sorting a source: words are counted by the leading bits of the rank, then
by further bits inside the one bucket where the sample ends, and only the rows that share all these bits are ranked.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null id is an id. Rows that are
alike in id and text are separate documents that follow each other. A document of size 0 takes 0 words.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, materialize

SHARE = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)
SEED = "mix"
_BITS = 52
# Bits of the rank that are still open after each count of words.
_OPEN = (40, 28, 16)


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size in words, weight, digest of the text, and a number of 52 bits drawn from the id."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"))), 1, 13), 16, 10)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        (F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))).alias("weight"),
        F.xxhash64("text").alias("digest"), drawn.cast("long").alias("draw"))


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target of (source, source_size); `weights` go round the sources by code point, null last.

    One row for each source, so the windows run over the list of sources, as long as the recipe of a mix is.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_place", F.row_number().over(by_name)).withColumn(
        "_w", F.element_at(F.lit(list(weights)), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    everything = Window.partitionBy()
    filling = Window.orderBy("_full", "_place")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    # The level at which weight times level is the target, if exactly the sources that fill up earlier are full.
    leveled = (
        weighed.withColumn("_full", most * F.col("source_size") / F.col("_w"))
        .withColumn("_budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("_taken", most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
        .withColumn("_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_taken")) / F.col("_left")))
    # Ascending in the order of filling up, so the first source that does not fill up has the level of all.
    level = F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "_place", "_level"))).over(everything)["_level"]
    return leveled.withColumn("_common", level).select(
        "source", "source_size",
        F.when(F.col("_full") > F.col("_common"), F.col("_w") * F.col("_common"))
        .otherwise(F.lit(float(most)) * F.col("source_size")).alias("target"))


def _factors(rows: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """source, source_size, target, factor: copies expected for weight 1, where no document has more than `most`."""
    known = materialize(targets.withColumns({"factor": F.lit(0.0), "n_full": F.lit(-1).cast("long")}), "mix-factors")
    while True:
        full = F.col("_factor") * F.col("weight") >= most
        near = known.select(F.col("source").alias("_source"), F.col("factor").alias("_factor"))
        now = rows.join(near, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(
            F.count_if(full).alias("_n"), F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)).alias("_words"),
            F.sum(F.when(~full, F.col("weight") * F.col("size"))).alias("_open"))
        now = now.withColumnRenamed("source", "_source")
        left = F.col("target") - most * F.col("_words")
        after = known.join(now, F.col("source").eqNullSafe(F.col("_source"))).select(
            "source", "source_size", "target",
            F.when(F.col("_open") > 0, F.greatest(left / F.col("_open"), F.col("factor"))).otherwise(F.col("factor")).alias("factor"),
            F.col("_n").alias("n_full"), (F.col("_n") != F.col("n_full")).alias("moved"))
        after = materialize(after, "mix-factors")
        if after.where("moved").isEmpty():
            return after.drop("n_full", "moved")
        known = after.drop("moved")


def _sample_ends(ranked: DataFrame, left: DataFrame) -> DataFrame:
    """source and the rank (key, draw, doc_id, digest, copy) of the last document inside the sample of each source."""
    state, closed = left.select("source", F.lit(0).cast("long").alias("bucket"), "need"), 63
    for is_open in _OPEN:
        near = state.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "need")
        inside = ranked.join(near, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("key", closed) == F.col("_bucket")))
        words = inside.groupBy("source", F.shiftright("key", is_open).alias("bucket"), "need").agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
        state = materialize(
            words.withColumn("_before", before).where((F.col("_before") < F.col("need")) & (F.col("_before") + F.col("words") >= F.col("need")))
            .select("source", "bucket", (F.col("need") - F.col("_before")).alias("need")), "mix-buckets")
        closed = is_open
    near = state.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "need")
    inside = ranked.join(near, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("key", closed) == F.col("_bucket")))
    order = [F.col("key"), F.col("draw"), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    upto = F.sum("size").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    number = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    alike = F.row_number().over(Window.partitionBy("source", "key", "draw", "doc_id", "digest").orderBy("size"))
    taken = inside.withColumns({"_upto": upto, "_number": number, "_copy": alike}).where(2 * F.col("_upto") - F.col("size") < 2 * F.col("need"))
    last = taken.groupBy("source").agg(F.max_by(F.struct("key", "draw", "doc_id", "digest", "_copy"), "_number").alias("last"))
    return materialize(
        left.select("source").join(state.select(F.col("source").alias("_s"), F.col("bucket")), F.col("source").eqNullSafe(F.col("_s")), "left")
        .join(last.withColumnRenamed("source", "_l"), F.col("source").eqNullSafe(F.col("_l")), "left")
        .select(F.col("source").alias("_source"), "bucket", "last"), "mix-ends")


def mix(docs: DataFrame, targets: DataFrame | None = None, weight: Column | None = None, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document of (doc_id, source, text).

    `targets` has (source, source_size, target), by default those of `source_targets`; `weight` is the expression
    of a document's weight inside its source, by default 1. No document has more than `most` copies.
    """
    rows = materialize(sized(docs, weight), "mix-sizes")
    if targets is None:
        targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most=most)
    factors = _factors(rows, targets, most)
    expected = F.least(F.coalesce(F.col("factor") * F.col("weight"), F.lit(0.0)), F.lit(float(most)))
    u = (F.col("draw") + F.lit(0.5)) / F.lit(2.0**_BITS)
    p = F.col("_p")
    # Rises with the Pareto rank (u/(1-u)) / (p/(1-p)), and lies between 0 and 1.
    rank = F.when(p > 0, u * (1 - p) / (p * (1 - u) + u * (1 - p))).otherwise(1.0)
    ranked = (
        rows.join(factors.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_expected", expected).withColumn("whole", F.floor("_expected"))
        .withColumn("_p", F.col("_expected") - F.col("whole"))
        .withColumn("key", F.floor(rank * F.lit(2.0**_BITS))))
    ranked = materialize(ranked.select("doc_id", "source", "size", "source_size", "target", "whole", "_p", "key", "draw", "digest"), "mix-ranked")
    left = materialize(
        ranked.groupBy("source", "target").agg(F.sum(F.col("whole") * F.col("size")).alias("_sure"))
        .select("source", (F.col("target") - F.col("_sure")).alias("need")), "mix-left")
    ends = _sample_ends(ranked.where("_p > 0"), left)
    same = F.struct("key", "draw", "doc_id", "digest") == F.struct("last.key", "last.draw", "last.doc_id", "last.digest")
    placed = ranked.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_edge", (F.col("_p") > 0) & F.coalesce(same, F.lit(False)))
    # A null id ranks below all others, as a struct compares it.
    ahead = F.struct("key", "draw", "doc_id", "digest") < F.struct("last.key", "last.draw", "last.doc_id", "last.digest")
    inside = F.when(F.col("last").isNull(), F.shiftright("key", _OPEN[-1]) < F.col("bucket")).otherwise(ahead)
    out = ["doc_id", "source", "size", "source_size", "target"]
    apart = placed.where(~F.col("_edge")).select(
        *out, (F.col("whole") + ((F.col("_p") > 0) & F.coalesce(inside, F.lit(False))).cast("long")).alias("copies"))
    numbered = F.row_number().over(Window.partitionBy("source").orderBy("size"))
    edge = placed.where("_edge").withColumn("_n", numbered).select(
        *out, (F.col("whole") + (F.col("_n") <= F.col("last._copy")).cast("long")).alias("copies"))
    return apart.unionByName(edge)


def op13_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2 in turn and share 150 % of all words; documents of a source weigh alike."""
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
