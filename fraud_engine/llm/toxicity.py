"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon, the trees and the calibration are learned from disjoint parts of a bounded sample of labelled
documents: at most `MAX_LABELLED` of each class, taken by a hash of the id, with the classes weighted
back to their shares. The lexicon holds words and beginnings of words that are far more frequent in toxic
documents; the other features are second-person words near lexicon words, capitals, punctuation and
obfuscation. Features are computed from whole texts, scores for all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, id_text, materialize
from fraud_engine.llm.textbatch import slices, text_bytes

#: Labelled documents of each class that the model is learned from.
MAX_LABELLED = 10_000
STEMS = range(3, 9)
LEAST_RATIO = 4.0
#: Words between a second-person word and a lexicon word.
NEAR = 5
ROUNDS, DEPTH = 30, 4
#: Words of a task whose lexicon weight is remembered.
KNOWN_WORDS = 300_000

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous "
    "votre vos usted ustedes tú ti tus vosotros os").split()

FEATURES = (
    "hit_density", "hit_weight", "log_hits", "strongest", "near_density", "capitals", "exclaims", "punctuation",
    "obfuscated", "log_words")

_words = re.compile(r"[^\W\d_]+").findall


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, np.int64)
    found[list(chars)] = 1
    return found


_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_PUNCTUATION = _table(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_MASK = _table(b"0123456789@$*#!|+._-")


class Weights(dict):
    """Lexicon weight of a word, looked up by the word and by its beginnings; -1 for second person."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.second = lexicon, set(SECOND_PERSON)

    def __missing__(self, word: str) -> float:
        best = self.lexicon.get(word, 0.0)
        for n in STEMS:
            if n < len(word):
                best = max(best, self.lexicon.get(word[:n] + "*", 0.0))
        if not best and word in self.second:
            best = -1.0
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = best
        return best


def terms_of(text: str) -> set[str]:
    words = set(_words(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}


def _feature_rows(texts: pa.Array, weights: Weights) -> np.ndarray:
    data, offsets = text_bytes(texts)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]
    letter = _LETTER[data]
    inside = np.zeros(len(data), np.int64)
    inside[1:-1] = _MASK[data[1:-1]] * letter[:-2] * letter[2:]
    n_letters, n_bytes = np.maximum(per_row(letter), 1), np.maximum(np.diff(offsets), 1)
    out[:, 5] = per_row(_UPPER[data]) / n_letters
    out[:, 6] = per_row((data == 33).astype(np.int64)) / n_bytes
    out[:, 7] = per_row(_PUNCTUATION[data]) / n_bytes
    out[:, 8] = per_row(inside) / n_bytes
    for row, text in enumerate(texts.fill_null("").to_pylist()):
        words = _words(text.lower())
        n = len(words)
        out[row, 9] = math.log1p(n)
        if not n:
            continue
        found = np.fromiter(map(weights.__getitem__, words), np.float64, n)
        hits = np.flatnonzero(found > 0)
        if len(hits):
            out[row, 0] = len(hits) / n
            out[row, 1] = found[hits].sum() / n
            out[row, 2] = math.log1p(len(hits))
            out[row, 3] = found[hits].max()
            second = np.flatnonzero(found < 0)
            if len(second):
                at = np.searchsorted(second, hits)
                gap = np.minimum(
                    np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
                out[row, 4] = np.count_nonzero(gap <= NEAR) / n
    return out


#: The name under which whole rows pass through the scoring.
CARRIED = "_carried"


def features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id, text_key and `features`, an array in the order of FEATURES; a null or empty text has zeros.

    A column CARRIED passes through, so that a filter on the score needs no join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # as many terms as the bounded sample can give
    kept = ["doc_id", "text_key", *([CARRIED] if CARRIED in docs.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(shared.value)
        for batch in slices(batches):
            rows = _feature_rows(batch.column("text"), weights)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(list(rows), pa.list_(pa.float64()))], names=[*kept, "features"])

    keyed = docs.select(*docs.columns, F.xxhash64("text").alias("text_key"))
    schema = keyed.select(*kept, F.array().cast("array<double>").alias("features")).schema
    return keyed.mapInArrow(run, schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: Counter = Counter()
            for text in batch.column("text").fill_null("").to_pylist():
                found.update(terms_of(text))
            yield pa.record_batch({"term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log ratio of each term whose share of toxic documents is at least LEAST_RATIO times that of clean ones."""
    support = max(3, n_toxic // 200)
    often = term_counts(toxic).where(F.col("n") >= support)
    both = often.join(term_counts(clean).withColumnRenamed("n", "n_clean"), "term", "left")
    ratio = ((F.col("n") + 0.5) / (n_toxic + 1)) / ((F.coalesce("n_clean", F.lit(0)) + 0.5) / (n_clean + 1))
    return {r["term"]: math.log(r["ratio"]) for r in both.select("term", ratio.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO).collect()}


class Model:
    """Lexicon, trees and calibration; without both classes in the labels, one constant score."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, carry: bool = False) -> DataFrame:
        """doc_id, text_key (hash of the text), score (0 to 1) of every row, and with `carry` the whole row as the struct CARRIED."""
        row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(CARRIED)] if carry else []
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
        kept = ["doc_id", "text_key", *([CARRIED] if carry else [])]
        if self.trees is None:
            return docs.withColumn("text_key", F.xxhash64("text")).select(*kept, F.lit(self.constant).cast("double").alias("score"))
        margin = _margins(self.trees, features(docs, self.lexicon))
        scored = self.calibration.transform(margin)
        return scored.select(*kept, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _margins(trees, rows: DataFrame) -> DataFrame:
    made = trees.transform(rows.withColumn("vector", array_to_vector("features")))
    return made.withColumn("margin", vector_to_array("rawPrediction")[1])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from (doc_id, text) and (doc_id, toxic); labels that are null or not 0 or 1 are left out.

    An id with several labels counts as toxic if one of them says so.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("_h", F.xxhash64("doc_id")))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model({}, constant=float(max(totals, default=0)) if totals else 0.0)
    chosen = materialize(
        known.where("toxic = 1").orderBy("_h").limit(max_labelled)
        .unionByName(known.where("toxic = 0").orderBy("_h").limit(max_labelled)), "toxicity-labels")
    # At most 2 * max_labelled ids are broadcast, so the texts stay where they are.
    sample = materialize(
        id_text(docs).join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4))),
        "toxicity-sample")
    counts = {(r["toxic"], r["part"]): r["count"] for r in sample.groupBy("toxic", "part").count().collect()}
    n = {c: sum(v for (k, _), v in counts.items() if k == c) for c in (0, 1)}
    if not n[0] or not n[1]:
        return Model({}, constant=float(n[1] > 0))
    # Disjoint parts, if each has both classes.
    split = all(counts.get((c, p), 0) >= 5 for c in (0, 1) for p in range(4))
    words, trees, rest = ([0, 1], [2], [3]) if split else (list(range(4)),) * 3
    for_words = sample.where(F.col("part").isin(words))
    sizes = [sum(counts.get((c, p), 0) for p in words) for c in (0, 1)]
    lexicon = learn_lexicon(for_words.where("toxic = 1"), for_words.where("toxic = 0"), sizes[1], sizes[0])
    weight = {c: totals[c] / n[c] for c in (0, 1)}
    rows = features(sample.where(F.col("part").isin(trees + rest)).select("doc_id", "text"), lexicon).join(
        F.broadcast(chosen), "doc_id").withColumns({
            "weight": F.when(F.col("toxic") == 1, weight[1]).otherwise(weight[0]),
            "label": F.col("toxic").cast("double"),
            "part": F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4))})
    # Few rows in a fixed order, so the splits do not depend on the cluster.
    rows = materialize(rows.repartition(1).sortWithinPartitions("doc_id", "features"), "toxicity-rows").coalesce(1)
    fitted = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.1,
        subsamplingRate=1.0, minInstancesPerNode=5, seed=7, cacheNodeIds=False,
    ).fit(rows.where(F.col("part").isin(trees)).withColumn("vector", array_to_vector("features")))
    margins = _margins(fitted, rows.where(F.col("part").isin(rest)))
    calibration = IsotonicRegression(
        featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(
            margins.select("margin", "label", "weight"))
    return Model(lexicon, fitted.setPredictionCol("_class").setProbabilityCol("_share"), calibration)


def learnable(doc_id) -> F.Column:
    """Whether a document may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def score_documents(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, text_key of every row; a null id is not held out.

    With `carry` there is CARRIED as well, the whole row as a struct.
    """
    model = fit(docs, labels.where(learnable(F.col("doc_id"))))
    return model.score(docs, carry).select(
        "doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_key", *([CARRIED] if carry else []))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_key")
