"""A whole table in one order, part by part, without a window over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rank error of cut points is at most one part in this many.
_ACCURACY = 10_000
_FIRST = np.iinfo(np.int64).min


def in_order(df: DataFrame, order: list[str], n_parts: int) -> DataFrame:
    """The rows by ranges of the first column of `order`: partition after partition in order, nulls first.

    The cut points come from a sample of that column on the driver, so it must be a narrow one.
    """
    return df.repartitionByRange(n_parts, order[0]).sortWithinPartitions(*order)


def cut_points(df: DataFrame, column: str, n_parts: int) -> list[int]:
    """At most n_parts - 1 values that cut `column` into ranges of about equal numbers of rows."""
    if n_parts < 2:
        return []
    shares = [k / n_parts for k in range(1, n_parts)]
    found = df.agg(F.percentile_approx(column, shares, _ACCURACY).alias("c")).first()["c"]
    return sorted(set(found or []))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(_FIRST).to_numpy(zero_copy_only=False)


def in_order_with_next(docs: DataFrame, n_parts: int) -> DataFrame:
    """(part, doc_id, text, is_next) sorted by all of them but text last, a part whole in one partition.

    The parts are ranges of doc_id. Behind its own rows a part holds, marked `is_next`, the first rows of
    the part that follows it (behind the last part, of the first one), so each own row finds the row
    that comes after it in the same partition. The driver sees one id for each part.
    """
    docs = docs.select("doc_id", "text")
    cuts = np.array(cut_points(docs, "doc_id", n_parts), np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(cuts, _ids(batch), side="right").astype(np.int32)
            yield pa.record_batch({"part": pa.array(part), "doc_id": batch.column("doc_id")})

    first_of = {
        r[0]: _FIRST if r[2] else r[1] for r in
        docs.select("doc_id").mapInArrow(place, "part int, doc_id long").groupBy("part")
        .agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).collect()}
    filled = sorted(first_of)
    # The part before each filled part; the last one is before the first.
    before = dict(zip(filled, filled[-1:] + filled[:-1]))
    firsts = np.array([first_of[p] for p in filled], np.int64)
    owners = np.array([before[p] for p in filled], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            part = np.searchsorted(cuts, ids, side="right").astype(np.int32)
            text = batch.column("text")
            yield pa.record_batch({
                "part": pa.array(part), "doc_id": batch.column("doc_id"), "text": text,
                "is_next": pa.array(np.zeros(len(ids), bool))})
            at = np.searchsorted(firsts, ids)
            at[at == len(firsts)] = 0
            again = np.flatnonzero(firsts[at] == ids)
            if len(again):
                yield pa.record_batch({
                    "part": pa.array(owners[at[again]]), "doc_id": batch.column("doc_id").take(again),
                    "text": text.take(again), "is_next": pa.array(np.ones(len(again), bool))})

    dealt = docs.mapInArrow(deal, "part int, doc_id long, text string, is_next boolean")
    return dealt.repartition(max(1, len(filled)), "part").sortWithinPartitions("part", "is_next", "doc_id", "text")
