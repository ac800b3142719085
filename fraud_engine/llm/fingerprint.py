"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed share of all hashes, so sketches of any documents can be
united and intersected like the sets themselves, and the share of a small document inside a large one
can be estimated. A text with shingles but none below the limit keeps its smallest hash, so no two
texts look alike only because they are short; it merges like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fraud_engine.llm.common import documents, id_text, parts_for
from fraud_engine.llm.ordered import in_order_with_next
from fraud_engine.llm.textbatch import SPACED, Words, shingles, slices, text_bytes

SHINGLE = 5
#: One hash of so many is kept.
SCALE = 8


def sketches(texts: pa.Array, shingle: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted hashes of each row's sketch; a null text is empty, and so is its sketch."""
    data, offsets = text_bytes(texts)
    hashes, row = shingles(Words(data, offsets, SPACED), shingle)
    n_rows = len(offsets) - 1
    least = np.full(n_rows, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, row, hashes)
    low = hashes < np.uint64((1 << 64) // scale - 1)
    empty = np.ones(n_rows, bool)
    empty[row[low]] = False
    keep = low | (empty[row] & (hashes == least[row]))
    hashes, row = hashes[keep], row[keep]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    at = np.searchsorted(row, np.arange(n_rows + 1))
    return [hashes[a:b] for a, b in zip(at[:-1], at[1:])]


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both documents together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller sketch inside the other; 1 if both are empty, 0 if one is."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text, or all."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex, 16 digits a hash) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "fingerprint": pa.array(list(map(to_text, sketches(batch.column("text")))), pa.string())})

    return id_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


_COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, jaccard_edited double, jaccard_next double")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness (containment, Jaccard).

    Documents follow each other by doc_id, rows of one id by text, null ids first; after the last comes
    the first, so a lone document follows itself. A null text is empty.
    """
    whole = id_text(docs).fillna("", ["text"])
    dealt = in_order_with_next(whole, parts_for(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in slices(batches):
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = batch.slice(batch.num_rows - 1)
            own = np.flatnonzero(~batch.column("is_next").to_numpy(zero_copy_only=False)[:-1])
            if not len(own):
                continue
            texts = batch.column("text").to_pylist()
            changed = [edited(texts[i], texts[i + 1]) for i in own]
            all_sketches = sketches(batch.column("text"))
            mine, following = [all_sketches[i] for i in own], [all_sketches[i + 1] for i in own]
            other = sketches(pa.array(changed, pa.large_string()))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(own),
                "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                "fingerprint": pa.array(list(map(to_text, mine)), pa.string()),
                "edited_fingerprint": pa.array(list(map(to_text, other)), pa.string()),
                "near_edited": pa.array(list(map(containment, mine, other)), pa.float64()),
                "near_next": pa.array(list(map(containment, mine, following)), pa.float64()),
                "jaccard_edited": pa.array(list(map(jaccard, mine, other)), pa.float64()),
                "jaccard_next": pa.array(list(map(jaccard, mine, following)), pa.float64())})

    return dealt.mapInArrow(run, _COMPARED)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
