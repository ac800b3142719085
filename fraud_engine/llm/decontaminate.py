"""Benchmark decontamination: a broadcast hash set of benchmark n-grams scanned by every document.

Windows of the benchmark are hashed and sorted. Each task hashes the word windows of its documents,
looks them up, compares the words of every hit with the benchmark's own words, and marks the words
covered. The set is broadcast in slices of at most `SLICE_WINDOWS` windows, so its size is bounded; a
benchmark with more windows is scanned slice by slice and the marks of a document are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, materialize
from fraud_engine.llm.textbatch import ALNUM, Words, ngrams, slices, text_bytes

WINDOW = 10
#: Windows of the benchmark in one broadcast, about 100 bytes each.
SLICE_WINDOWS = 500_000



class WindowSet:
    """Windows of some benchmark items, by number of words and sorted hash."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items = [i for i, _ in items]
        self.by_length: dict[int, tuple] = {}
        found: dict[int, list] = {}
        column = pa.array([t or "" for _, t in items], pa.large_string())
        words = Words(*text_bytes(column), ALNUM)
        hashes = words.hashes()
        for k in range(len(items)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if a == b:
                continue
            n = min(window, b - a)
            own = [words.text(i) for i in range(a, b)]
            for j, h in enumerate(ngrams(hashes[a:b], n)):
                found.setdefault(n, []).append((int(h), b" ".join(own[j:j + n]), k))
        for n, rows in found.items():
            rows.sort()
            self.by_length[n] = (
                np.array([r[0] for r in rows], np.uint64), [r[1] for r in rows], [r[2] for r in rows])

    def scan(self, words: Words) -> tuple[np.ndarray, list[set[int]]]:
        """Which words are hit, and the items of each row."""
        hashes, counts = words.hashes(), words.counts()
        rows = np.repeat(np.arange(len(counts)), counts)
        covered = np.zeros(len(hashes) + 1, np.int64)
        items: list[set[int]] = [set() for _ in counts]
        for n, (sorted_hashes, texts, owners) in self.by_length.items():
            grams = ngrams(hashes, n)
            if not len(grams):
                continue
            at = np.searchsorted(sorted_hashes, grams)
            at[at == len(sorted_hashes)] = 0
            hits = np.flatnonzero((sorted_hashes[at] == grams) & (rows[: len(grams)] == rows[n - 1:]))
            for p in hits:
                said = b" ".join(words.text(i) for i in range(p, p + n))
                k, any_hit = int(at[p]), False
                while k < len(texts) and sorted_hashes[k] == grams[p]:
                    if texts[k] == said:
                        any_hit = True
                        items[rows[p]].add(owners[k])
                    k += 1
                if any_hit:
                    covered[p] += 1
                    covered[p + n] -= 1
        return np.cumsum(covered)[:-1] > 0, items


def _windows_of(benchmark: DataFrame, window: int, slice_windows: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of at most `slice_windows` windows (or of one item), streamed to the driver."""
    part, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = max(1, len((row[1] or "").encode()) // 2 - window)
        if part and held + n > slice_windows:
            yield part
            part, held = [], 0
        part.append((row[0], row[1]))
        held += n
    if part:
        yield part


_CARRIED = "_carried"


def _scan(found: DataFrame, items: list[tuple[str, str]], window: int, out: list[str]) -> DataFrame:
    """The rows of `found` with the hits of these items added to those that are there, as the columns `out`."""
    shared = found.sparkSession.sparkContext.broadcast(WindowSet(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            words = Words(*text_bytes(batch.column("text")), ALNUM)
            hit, found = known.scan(words)
            first = words.first
            before, named = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            n_words = np.diff(first)
            for r, bits in enumerate(before):
                if bits is not None:
                    hit[first[r]:first[r + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8))[: n_words[r]].astype(bool)
            sums = np.concatenate([[0], np.cumsum(hit)])
            made = {
                "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(sums[first[1:]] - sums[first[:-1]], pa.int64()),
                "items": pa.array(
                    [sorted({known.items[i] for i in s if known.items[i] is not None} | set(own or [])) for s, own in zip(found, named)],
                    pa.list_(pa.string())),
                "hits": pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in out], names=out)

    return found.mapInArrow(run, found.select(*out).schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_windows: int = SLICE_WINDOWS,
         keep_text: bool = False, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), hits (a bit for each word) of every document; with `keep_text` its text,
    with `carry` the whole row as the struct `_carried`.

    A null or empty text has no words, an item without words no window, and an item without id names no
    item though its words are hit. Rows that repeat are found each on their own. An empty benchmark
    hits nothing. The documents pass the slices of the benchmark one after the other, and are written in between,
    so that no more than one slice is held.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_CARRIED)] if carry else []
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("binary").alias("hits"), *whole)
    parts = _windows_of(benchmark, window, slice_windows)
    part = next(parts, [])
    for following in parts:
        found, part = materialize(_scan(found, part, window, found.columns), "scanned"), following
    return _scan(found, part, window, [c for c in found.columns if keep_text or c != "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, text: every document without its hit words; what stands between two words stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            words = Words(data, offsets, ALNUM)
            bits = [np.unpackbits(np.frombuffer(h, np.uint8))[:n] for h, n in
                    zip(batch.column("hits").to_pylist(), batch.column("n_words").to_pylist())]
            hit = np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool)
            gone = np.zeros(len(data) + 1, np.int64)
            np.add.at(gone, words.start[hit], 1)
            np.add.at(gone, words.end[hit], -1)
            keep = np.cumsum(gone)[:-1] == 0
            texts = [data[a:b][keep[a:b]].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "text": pa.array([None if not ok else t for t, ok in zip(texts, batch.column("text").is_valid().to_pylist())], pa.string())})

    return find(docs, benchmark, keep_text=True, **options).mapInArrow(run, "doc_id long, text string")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document windows of the benchmark cover, and of which items."""
    found = find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
