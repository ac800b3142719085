"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of other characters than letters counts as a space, and n-grams of 1 to 3
characters are hashed to `DIMENSIONS` places. Document frequencies come from all documents that may be
learned from. The weights are learned from a bounded sample, `MAX_LEARNED` documents of each language by a
hash of the id, by follow-the-regularised-leader with elastic-net penalties; a fifth of the sample is
kept back for one temperature. A text gets the language of the largest logit and the calibrated share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, materialize
from fraud_engine.llm.textbatch import mix, slices, text_bytes

BITS = 16
DIMENSIONS = 1 << BITS
ORDERS = (1, 2, 3)
MAX_LEARNED = 1_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
#: Frequencies are small; this brings features near 1.
SCALE = 20.0
#: Pieces of the table of document frequencies.
PIECES = 16
UNKNOWN = "und"

_U = np.uint64
_KNOWN = 0x250
_LOW = np.zeros(_KNOWN, np.uint32)
for _c in range(_KNOWN):
    _lower = chr(_c).lower()
    if chr(_c).isalpha():
        _LOW[_c] = ord(_lower) if len(_lower) == 1 else _c


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters as code points and 0 for all else, the place of each row, letters of each row."""
    data, offsets = text_bytes(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = _LOW[np.minimum(points, _KNOWN - 1)]
    high = np.flatnonzero(points >= _KNOWN)
    if len(high):
        values, back = np.unique(points[high], return_inverse=True)
        lower = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, values)]
        low[high] = np.array([v if chr(p).isalpha() else 0 for p, v in zip(values, lower)], np.uint32)[back]
    letters = np.concatenate([[0], np.cumsum(low > 0)])
    return low, first, letters[first[1:]] - letters[first[:-1]]


def gram_places(low: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashed place of the n-gram from each symbol on, and the places of the rows.

    n-grams that would cross into the next row are left out.
    """
    wide = low.astype(_U)
    lengths = np.diff(first)
    for n in ORDERS:
        m = len(low) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(first), np.int64)
            continue
        key = np.full(m, n, _U)
        for j in range(n):
            key = key * _U(0x100000001B3) + wide[j:j + m]
        places = (mix(key) >> _U(64 - BITS)).astype(np.int64)
        own = np.maximum(lengths - n + 1, 0)
        if n > 1:
            keep = np.ones(m + n - 1, bool)
            for j in range(1, n):
                at = first[1:] - j
                keep[at[(at >= first[:-1]) & (at >= 0)]] = False
            places = places[keep[:m]]
        yield places, np.concatenate([[0], np.cumsum(own)])


def row_counts(low: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count) of the n-grams, by row."""
    keys = []
    for places, at in gram_places(low, first):
        keys.append(np.repeat(np.arange(len(at) - 1), np.diff(at)) << BITS | places)
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return found >> BITS, found & (DIMENSIONS - 1), counts


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each place, and all documents; each task sends one small table."""
    width = DIMENSIONS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in slices(batches):
            low, first, _ = symbols(batch.column("text"))
            seen += np.bincount(row_counts(low, first)[1], minlength=DIMENSIONS)
            n += batch.num_rows
        yield pa.record_batch({
            "piece": pa.array(range(PIECES), pa.int32()), "n": pa.array([n] * PIECES, pa.int64()),
            "seen": pa.array([seen[k * width:(k + 1) * width].tobytes() for k in range(PIECES)], pa.binary())})

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(width, np.int64), 0
        for batch in batches:
            for part, rows in zip(batch.column("seen"), batch.column("n").to_pylist()):
                seen += np.frombuffer(part.as_py(), np.int64)
                n += rows
        yield pa.record_batch({"piece": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "seen": pa.array([seen.tobytes()], pa.binary())})

    schema = "piece int, n long, seen binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("piece").applyInArrow(total, schema).collect()
    if not rows:
        return np.zeros(DIMENSIONS, np.int64), 0
    return np.concatenate([np.frombuffer(r["seen"], np.int64) for r in sorted(rows, key=lambda r: r["piece"])]), rows[0]["n"]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (DIMENSIONS + 1, n_classes) by FTRL-proximal; the last place is the bias."""
    z = np.zeros((DIMENSIONS + 1, n_classes))
    n = np.zeros_like(z)

    def weights(at) -> np.ndarray:
        own = z[at]
        shrunk = np.sign(own) * np.maximum(np.abs(own) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            places, values, label = rows[k]
            w = weights(places)
            share = softmax(values @ w)
            share[label] -= 1.0
            g = values[:, None] * share[None, :]
            sigma = (np.sqrt(n[places] + g * g) - np.sqrt(n[places])) / ALPHA
            z[places] += g - sigma * w
            n[places] += g * g
    return weights(slice(None))


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log likelihood, on a grid of ratios 1.1."""
    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).sum()
    return min((1.1**k for k in range(-30, 31)), key=loss) if len(labels) else 1.0


class Model:
    """Languages, weights times document-frequency weights, bias, temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        low, first, letters = symbols(texts)
        n_rows, k = len(first) - 1, len(self.languages)
        if not k:
            return [UNKNOWN] * n_rows, np.zeros(n_rows)
        logits, totals = np.zeros((n_rows, k)), np.zeros(n_rows)
        for places, at in gram_places(low, first):
            full = np.flatnonzero(np.diff(at))
            if len(full):
                logits[full] += np.add.reduceat(self.table[places], at[full], axis=0)
                totals += np.diff(at)
        shares = softmax((logits * SCALE / np.maximum(totals, 1)[:, None] + self.bias) / self.temperature)
        best = shares.argmax(axis=1)
        none = letters == 0
        return [UNKNOWN if e else self.languages[b] for b, e in zip(best, none)], np.where(none, 1.0, shares[np.arange(n_rows), best])


def fit(docs: DataFrame, max_learned: int = MAX_LEARNED) -> Model:
    """Learn from (doc_id, text, lang); rows without language or text are left out."""
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen, n_docs = document_frequencies(known)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + n_docs) / (1 + seen)) + 1.0
    # The share of each language that gives about max_learned documents.
    take = F.create_map(*[v for name, c in counts.items() for v in (F.lit(name), F.lit(min(1.0, max_learned / c)))])
    unit = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(unit < take[F.col("lang")])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            low, first, _ = symbols(batch.column("text"))
            row, place, count = row_counts(low, first)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "lang": batch.column("lang"),
                "places": pa.array([place[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                "counts": pa.array([count[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for lang, p, c in zip(*(batch.column(x).to_pylist() for x in ("lang", "places", "counts"))):
                places, count = np.frombuffer(p, np.int32), np.frombuffer(c, np.int32).astype(float)
                values = count / max(count.sum(), 1) * idf[places] * SCALE
                rows.append((np.append(places, DIMENSIONS), np.append(values, 1.0), languages.index(lang)))
        if not rows:
            return
        kept = rows[::5] if len(rows) >= 50 else []
        learned = [r for i, r in enumerate(rows) if i % 5] if kept else rows
        weights = follow_the_leader(learned, len(languages))
        logits = np.array([v @ weights[p] for p, v, _ in kept]).reshape(len(kept), len(languages))
        temperature = best_temperature(logits, np.array([y for *_, y in kept], int))
        yield pa.record_batch({"weights": pa.array([weights.tobytes()], pa.binary()), "temperature": pa.array([temperature])})

    # The sample is bounded by max_learned of each language, so one task learns from it, in a fixed order.
    rows = materialize(sample.mapInArrow(rows_of, "doc_id long, lang string, places binary, counts binary"), "language-rows")
    made = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "places"), "doc_id").mapInArrow(
        learn, "weights binary, temperature double").first()
    if made is None:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), 1.0)
    weights = np.frombuffer(made["weights"]).reshape(DIMENSIONS + 1, len(languages))
    return Model(languages, (weights[:-1] * idf[:, None]).astype(np.float32), weights[-1], made["temperature"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; `und` with score 1 for a text that is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = shared.value.predict(batch.column("text"))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
