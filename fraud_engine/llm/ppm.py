"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to `ORDER` bytes with counts from all documents that may be learned
from. A byte is predicted in its longest known context; an unseen one escapes to the next shorter
context with probability distinct / (total + distinct), where symbols of the longer context are excluded
from the counts, down to equal shares of the bytes never seen. Exclusion needs sums only: a context's symbols are a subset of those
of its suffix, so what is excluded is the suffix's count of them, summed once for each context.

Text. A-Z are lower-cased, each word is followed by one space, the text by a line feed, which no word holds.

Plan. Documents are dealt into blocks. A block sends its distinct (context, byte) strings and words, with
their counts in learned documents, to buckets; strings whose last two context bytes agree are in one
bucket, so it holds all suffixes down to that length, and the counts of single bytes and pairs are a
small table that all buckets get. A bucket adds the counts of all blocks up and answers each block
with the log probability of its strings and the count of its words. The block then looks up every byte
of its documents. Nothing grows on the driver, and a frequent string is sent once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, id_text, materialize, parts_for
from fraud_engine.llm.textbatch import SPACED, Words, give_back, mix, slices, text_bytes

ORDER = 5
BLOCK_BYTES = 8 << 20
SPACE, END = 32, 10
_U = np.uint64
#: The end of a text as a word.
END_WORD = _U(0x6C62272E07BB0142)


class Strings:
    """Strings of a batch: `gram` of each byte (context and byte), `place` of the rows; `word` and `word_place`."""

    def __init__(self, texts: pa.Array, with_words: bool = True):
        words = Words(*text_bytes(texts), SPACED)
        lengths, counts = words.end - words.start, words.counts()
        n_rows = len(counts)
        row = np.repeat(np.arange(n_rows), counts)
        # Row r begins with ORDER line feeds that are context only.
        lead = (lengths + 1).cumsum() - (lengths + 1)
        begin = lead + (row + 1) * ORDER + row
        taken = np.concatenate([[0], np.cumsum(lengths + 1)])[words.first]
        out = np.full(int(taken[-1]) + n_rows * (ORDER + 1), SPACE, np.uint8)
        shift = np.repeat(begin - words.start, lengths)
        inside = np.arange(len(shift)) + np.repeat(words.start - (lengths.cumsum() - lengths), lengths)
        out[inside + shift] = words.data[inside]
        rows = np.arange(n_rows)
        starts = taken[:-1] + rows * (ORDER + 1)
        for j in range(ORDER):
            out[starts + j] = END
        ends = taken[1:] + (rows + 1) * (ORDER + 1) - 1
        out[ends] = END
        wide = out.astype(_U)
        gram = wide.copy()
        for j in range(1, ORDER + 1):
            gram[j:] |= wide[:-j] << _U(8 * j)
        real = np.ones(len(out), bool)
        for j in range(ORDER):
            real[starts + j] = False
        self.gram = gram[real]
        self.place = np.concatenate([[0], np.cumsum(np.diff(taken) + 1)])
        if with_words:
            self.word = np.empty(len(row) + n_rows, _U)
            at = np.arange(len(row)) + row
            self.word[at] = words.hashes()
            self.word_place = np.concatenate([[0], np.cumsum(counts + 1)])
            self.word[self.word_place[1:] - 1] = END_WORD


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _counted(keys: np.ndarray, place: np.ndarray, learned: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their counts in learned rows, and the others with count 0."""
    use = np.repeat(learned, np.diff(place))
    found, counts = np.unique(keys[use], return_counts=True)
    other = np.unique(keys[~use])
    return [(found, counts), (other, np.zeros(len(other), np.int64))]


def _bucket_of(grams: np.ndarray, words: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of strings (by their last two context bytes) and of words; words have buckets of their own."""
    share = lambda h: ((h >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int64)
    return share(mix((grams >> _U(8)) & _U(0xFFFF))), share(mix(words)) + n_buckets


def _by_bucket(keys: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys by bucket, the filled buckets, and where each begins (and the end)."""
    order = np.argsort(bucket, kind="stable")
    filled, first = np.unique(bucket[order], return_index=True)
    return order, filled, np.append(first, len(keys))


class Trie:
    """log10 probability of strings of one bucket, from merged counts and the table of byte pairs."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        self.pairs = pairs
        self.singles = pairs.sum(axis=0)
        seen = counts > 0
        keys, own = grams[seen], counts[seen]
        self.level: dict[int, tuple] = {}
        levels = {k: _merge([(keys & _U((1 << 8 * (k + 1)) - 1), own)]) for k in range(2, ORDER + 1)}
        for k, (known, number) in levels.items():
            context = known >> _U(8)
            first = np.ones(len(context), bool)
            first[1:] = context[1:] != context[:-1]
            at = np.flatnonzero(first)
            if k > 2:
                lower, lower_number = levels[k - 1]
                below = lower_number[np.searchsorted(lower, known & _U((1 << 8 * k) - 1))] if len(known) else number
            else:
                below = pairs[(known >> _U(8) & _U(0xFF)).astype(int), (known & _U(0xFF)).astype(int)]
            sums = (lambda v: np.add.reduceat(v, at)) if len(at) else (lambda v: v)
            self.level[k] = (known, number, context[at], sums(number), np.diff(np.append(at, len(context))), sums(below))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """The values of the wanted keys, 0 where a key is unknown."""
        if not len(keys):
            return [np.zeros(len(wanted), np.int64) for _ in values]
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        hit = keys[at] == wanted
        return [np.where(hit, v[at], 0) for v in values]

    def _stats(self, k: int, grams: np.ndarray) -> list[np.ndarray]:
        """Of order k: count of the byte, total, distinct bytes, the next order's count of those bytes."""
        if k >= 2:
            known, number, contexts, total, distinct, below = self.level[k]
            count, = self._find(known, grams & _U((1 << 8 * (k + 1)) - 1), number)
            return [count, *self._find(contexts, (grams >> _U(8)) & _U((1 << 8 * k) - 1), total, distinct, below)]
        byte, last = (grams & _U(0xFF)).astype(int), (grams >> _U(8) & _U(0xFF)).astype(int)
        if k == 1:
            below = (self.pairs > 0) @ self.singles
            return [self.pairs[last, byte], self.pairs.sum(axis=1)[last], (self.pairs > 0).sum(axis=1)[last], below[last]]
        n = len(grams)
        return [self.singles[byte], np.full(n, self.singles.sum()), np.full(n, (self.singles > 0).sum()), np.zeros(n, np.int64)]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        left = np.ones(len(grams), bool)
        gone_total, gone_distinct = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for k in range(ORDER, -1, -1):
            count, total, distinct, below = self._stats(k, grams)
            free, kinds = total - gone_total, distinct - gone_distinct
            hit = left & (count > 0)
            out[hit] += np.log10(count[hit] / (free[hit] + kinds[hit]))
            left &= ~hit
            escape = left & (free > 0)
            out[escape] += np.log10(kinds[escape] / (free[escape] + kinds[escape]))
            gone_total = np.where(total > 0, below, gone_total)
            gone_distinct = np.where(total > 0, distinct, gone_distinct)
        # The bytes that no document holds share what is left.
        out[left] -= np.log10(256 - (self.singles > 0).sum())
        return out


def _table_rows(table: pa.Table | list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from slices(iter(table.to_batches() if isinstance(table, pa.Table) else table))


def byte_pairs(docs: DataFrame) -> np.ndarray:
    """(256, 256) counts of (byte before, byte) in all texts; each task sends one small table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for batch in slices(batches):
            gram = Strings(batch.column("text"), with_words=False).gram
            seen += np.bincount((gram & _U(0xFFFF)).astype(np.int64), minlength=1 << 16)
        at = np.flatnonzero(seen)
        yield pa.record_batch({"pair": pa.array(at), "n": pa.array(seen[at])})

    rows = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect()
    out = np.zeros(1 << 16, np.int64)
    for pair, n in rows:
        out[pair] = n
    return out.reshape(256, 256)


_MESSAGE = "bucket int, block int, keys binary, counts binary"
_ANSWER = "block int, bucket int, values binary"
_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, log_known double, score double")


def score_documents(docs: DataFrame, learned, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    `learned` says of doc_id whether a document may be learned from (null: it may). A null or empty text
    is its end alone. Rows that repeat count as often as they stand. Without anything to learn, all bytes
    have equal shares.
    """
    whole = id_text(docs)
    spark = docs.sparkSession
    n_blocks = parts_for(whole, block_bytes)
    n_buckets = max(4, min(n_blocks, 1 << 12))
    held = whole.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "text",
        F.coalesce(~learned(F.col("doc_id")), F.lit(False)).alias("held_out"))
    pairs = spark.sparkContext.broadcast(byte_pairs(held.where(~F.col("held_out"))))

    def send(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = [], []
        for batch in slices(batches):
            strings = Strings(batch.column("text"))
            use = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            grams.append(_merge(_counted(strings.gram, strings.place, use)))
            words.append(_merge(_counted(strings.word, strings.word_place, use)))
        (gram, gram_n), (word, word_n) = _merge(grams), _merge(words)
        rows = []
        for keys, counts, bucket in zip((gram, word), (gram_n, word_n), _bucket_of(gram, word, n_buckets)):
            order, filled, at = _by_bucket(keys, bucket)
            keys, counts = keys[order], counts[order].astype(np.uint32)
            rows += [(b, keys[i:j].tobytes(), counts[i:j].tobytes()) for b, i, j in zip(filled.tolist(), at[:-1], at[1:])]
        yield pa.record_batch({
            "bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, keys, counts = key[0].as_py(), [], [], []
        for batch in batches:
            blocks += batch.column("block").to_pylist()
            keys += [np.frombuffer(k.as_py(), _U) for k in batch.column("keys")]
            counts += [np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for c in batch.column("counts")]
        merged, total = _merge(list(zip(keys, counts)))
        if bucket < n_buckets:
            values = Trie(merged, total, pairs.value).log10(merged).astype(np.float32)
        else:
            values = total
        for block, own in zip(blocks, keys):
            yield pa.record_batch({
                "block": pa.array([block], pa.int32()), "bucket": pa.array([bucket], pa.int32()),
                "values": pa.array([values[np.searchsorted(merged, own)].tobytes()], pa.binary())})
        if bucket >= n_buckets:
            yield pa.record_batch({
                "block": pa.array([-1], pa.int32()), "bucket": pa.array([bucket], pa.int32()),
                "values": pa.array([np.array([total.sum(), (total > 0).sum()]).tobytes()], pa.binary())})

    answers = materialize(held.groupBy("block").applyInArrow(send, _MESSAGE).groupBy("bucket").applyInArrow(answer, _ANSWER), "ppm-answers")
    # One row for each bucket of words.
    sums = [np.frombuffer(r["values"], np.int64) for r in answers.where("block < 0").collect()]
    n, v = map(int, np.sum(sums, axis=0)) if sums else (0, 0)

    def look_up(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        # The block's strings once more; of a slice its distinct ones, and which of them stands at each place.
        held_slices, parts = [], ([], [])
        for batch in _table_rows(left):
            strings = Strings(batch.column("text"))
            own = [np.unique(keys, return_inverse=True) for keys in (strings.gram, strings.word)]
            for found, (distinct, _) in zip(parts, own):
                found.append(distinct)
            held_slices.append((batch.select(["doc_id", "held_out"]), strings.place, strings.word_place, *(
                (distinct, at.astype(np.int32)) for distinct, at in own)))
        known = [np.unique(np.concatenate(p)) if p else np.zeros(0, _U) for p in parts]
        by_bucket = dict(zip(right["bucket"].to_pylist(), right["values"]))
        values = [np.zeros(len(known[0]), np.float32), np.zeros(len(known[1]), np.int64)]
        for out, keys, bucket in zip(values, known, _bucket_of(*known, n_buckets)):
            order, filled, at = _by_bucket(keys, bucket)
            for b, i, j in zip(filled.tolist(), at[:-1], at[1:]):
                out[order[i:j]] = np.frombuffer(by_bucket[b].as_py(), out.dtype)
        done = []
        for rows, place, word_place, (grams, gram_at), (words, word_at) in held_slices:
            chance = values[0][np.searchsorted(known[0], grams)].astype(float)[gram_at]
            count = values[1][np.searchsorted(known[1], words)][word_at]
            done.append(pa.record_batch({
                "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"),
                "n_tokens": pa.array(np.diff(word_place), pa.int64()),
                "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), word_place[:-1])),
                "log_known": pa.array(np.add.reduceat(np.log10(count + 1.0), word_place[:-1])),
                "score": pa.array(np.add.reduceat(chance, place[:-1]))}))
        give_back()
        if not done:  # answers without rows do not occur, but a group of none is not an error
            return left.select(["doc_id", "held_out"]).append_column("n_tokens", pa.array([], pa.int64())).append_column(
                "n_known", pa.array([], pa.int64())).append_column("log_known", pa.array([], pa.float64())).append_column("score", pa.array([], pa.float64()))
        return pa.Table.from_batches(done)

    scored = held.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(look_up, _SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_known") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score")


def learnable(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document by a byte model of order 5, beside a plain count of words."""
    return score_documents(documents(spark, sf_dir), learnable)
