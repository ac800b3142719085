"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, number of pieces, attention cost (sum of squared lengths).
A piece is its length, so all pieces of one length are alike and the packing is made on the histogram of
lengths: at most `max_tokens` rows, whatever the table. Lengths are taken from long to short. A length
goes to the kind of open sequence that fits under every capacity and is best by residual norm (the
least weighted norm of what stays free) or by dot product (the largest weighted product of
demand and free room); a kind stands for all sequences that are filled alike. If none fits, new
sequences are opened. Pieces then take the places of their length by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, id_text, materialize
from fraud_engine.llm.textbatch import slices
from fraud_engine.llm.tokens import VOCABULARY, Encoder

MAX_TOKENS = 2048
#: Rows that are ranked in one window.
RANKED_ROWS = 200_000


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence and the weights of the choice; None is no limit beyond the tokens."""

    tokens: int = MAX_TOKENS
    pieces: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    choose: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces: (length, first rank, end rank, first sequence, pieces in each, offset).

    Ranks count the pieces of one length. A row covers the ranks of sequences that are filled alike.
    """
    full, weights = capacity.vector(), np.array(capacity.weights)
    free = np.zeros((0, 3), np.int64)  # of each kind of open sequence
    many: list[int] = []
    filled: list[tuple[tuple[int, int], ...]] = []  # (length, pieces) in order

    def set_kind(k: int | None, room: np.ndarray, n: int, what: tuple) -> None:
        nonlocal free
        if k is None:
            free = np.vstack([free, room])
            many.append(n)
            filled.append(what)
        else:
            free[k], many[k], filled[k] = room, n, what

    for length in sorted(histogram, reverse=True):
        left, need = histogram[length], np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens is over the capacity of a sequence")
        fits = np.flatnonzero((free >= need).all(axis=1))
        while left and len(fits):
            room = free[fits]
            if capacity.choose == "norm":
                best = int(np.argmin((weights * ((room - need) / full) ** 2).sum(axis=1)))
            else:
                best = int(np.argmax((weights * (need / full) * (room / full)).sum(axis=1)))
            k = int(fits[best])
            each = int((free[k] // need).min())  # the same sequence stays the best while it fits
            n = min(many[k], left // each)
            if n:
                rest = many[k] - n
                old_room, old = free[k].copy(), filled[k]
                set_kind(k, free[k] - need * each, n, (*filled[k], (length, each)))
                if rest:
                    set_kind(None, old_room, rest, old)
                left -= n * each
            else:  # fewer pieces than one such sequence takes
                old_room, old, rest = free[k].copy(), filled[k], many[k] - 1
                set_kind(k, free[k] - need * left, 1, (*filled[k], (length, left)))
                if rest:
                    set_kind(None, old_room, rest, old)
                left = 0
            fits = np.flatnonzero((free >= need).all(axis=1)) if left else fits
        if left:
            each = int((full // need).min())
            if left // each:
                set_kind(None, full - need * each, left // each, ((length, each),))
            if left % each:
                set_kind(None, full - need * (left % each), 1, ((length, left % each),))
    rank, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for n, what in zip(many, filled):
        offset = 0
        for length, each in what:
            rows.append((length, rank[length], rank[length] + n * each, sequence, each, offset))
            rank[length] += n * each
            offset += length * each
        sequence += n
    return sorted(rows)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text as ids with the end id, cut if it is too long.

    The first piece of a long text takes what is over; the others are full. A null text is empty and has
    one piece, the end id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in slices(batches):
            rows = []
            all_ids, at = encoder.encode(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:]):
                raw, n = all_ids[a:b].astype("<u4").tobytes(), int(b - a)
                ends = list(range(n, 0, -max_tokens))[::-1]
                for piece, end in enumerate(ends):
                    start = ends[piece - 1] if piece else 0
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(raw[4 * start:4 * end])))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(run, _PIECES)


def ranked(pieces: DataFrame) -> DataFrame:
    """The pieces with their rank among those of the same length, from 0, without a window per length."""
    rows = pieces.count()
    salted = pieces.withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, -(-rows // RANKED_ROWS)))))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("_own", F.row_number().over(own)).join(firsts, ["length", "_salt"])
        .withColumn("rank", F.col("_first") + F.col("_own") - 1).drop("_salt", "_first", "_own"))


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """`pieces` with sequence_id and offset. Needs doc_id, piece, length and ids_crc32; repeated rows each get a place."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = plan(histogram, capacity)
    columns = [np.array(c, np.int64) for c in zip(*rows)] or [np.zeros(0, np.int64)] * 6
    # At most as many rows as kinds of sequences times their lengths; it follows the capacity, not the table.
    shared = pieces.sparkSession.sparkContext.broadcast(columns)
    placed = ranked(pieces)
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, _, sequences, eachs, offsets = shared.value
        top = int(firsts.max()) + 2 if len(firsts) else 2
        # (length, first rank) as one sorted number; both are below 2^63 / max_tokens in any table that fits a disk
        keys = lengths * (1 << 48) + firsts
        assert top < 1 << 48
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            i = rank - firsts[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequences[at] + i // eachs[at]),
                 pa.array(offsets[at] + i % eachs[at] * length)],
                names=[*names, "sequence_id", "offset"])

    schema = placed.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of all documents with their sequences; an empty table has none."""
    return pack(materialize(pieces_of(docs, capacity.tokens, vocabulary), "pieces"), capacity)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
