"""Ranked lexical search by presence masks.

Documents are cut into blocks. A block is stored as postings of the terms that occur in the queries: for each
term the documents of the block that hold it, and how often. Search goes block by block. For one item, the
postings of its terms set bits in a mask for each document; documents are grouped by equal masks. No
document can score more than the sum, over the bits of its mask, of the best contribution that the term has in
the block. Distinct masks are taken by this bound, highest first; their documents are scored exactly, and the
block is finished for the item once the next bound is below the lowest of the best `top` scores that
the task has seen so far. What the tasks find is merged by item.

Terms are maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased. Words of documents meet
terms by a hash and are then compared byte by byte. The arithmetic is exact in 64-bit integers.

Queries go in slices of a bounded size, each a broadcast and one pass over the documents.

Nulls: a null text has no terms, as document and as item. A null doc_id follows all others among equal scores.
Rows of one id are separate documents. Items alike in id and text are one; items of one id with different texts
are ranked apart. Other columns are not read. Empty tables and items without a match give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, materialize
from fraud_engine.llm.textbatch import ALNUM, Words, give_back, slices, text_bytes

TOP = 10
#: Bytes of item texts that are searched for in one pass.
SLICE_QUERY_BYTES = 4 << 20
#: Bytes of text in one block, and documents at most.
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 1 << 14

_BLOCK = (
    "block long, doc_ids array<long>, sizes array<long>, terms array<int>, begins array<long>, "
    "places array<int>, times array<int>")
_FOUND = "item int, doc_id long, score long"


class Terms:
    """The distinct terms of some texts: bytes, and a look-up of words that compares them."""

    def __init__(self, texts: list[str | None]):
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        numbers: dict[bytes, int] = {}
        for text in texts:
            own: dict[int, int] = {}
            words = Words(*text_bytes(pa.array([text], pa.large_string())), ALNUM)
            for i in range(len(words.start)):
                number = numbers.setdefault(words.text(i), len(numbers))
                own[number] = own.get(number, 0) + 1
            order = sorted(own)
            self.items.append((np.array(order, np.int64), np.array([own[t] for t in order], np.int64)))
        self.data = np.frombuffer(b"".join(numbers), np.uint8)
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        spaced = np.frombuffer(b" ".join(numbers), np.uint8)
        hashes = Words(spaced, np.array([0, len(spaced)]), ALNUM).hashes()
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if len(hashes) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of the queries have one hash")

    def __len__(self) -> int:
        return len(self.end)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of the words that are terms."""
        if not len(self) or not len(words.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        word = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[word]]
        size = self.end[term] - self.start[term]
        alike = words.end[word] - words.start[word] == size
        word, term, size = word[alike], term[alike], size[alike]
        if len(word):
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = words.data[np.repeat(words.start[word], size) + inner] == self.data[np.repeat(self.start[term], size) + inner]
            alike = np.logical_and.reduceat(same, np.cumsum(size) - size)
            word, term = word[alike], term[alike]
        return word, term


class _Block:
    """Postings of one block, filled text slice by text slice."""

    def __init__(self):
        self.ids, self.sizes, self.terms, self.places, self.times = [], [], [], [], []
        self.n_docs = self.n_bytes = 0

    def add(self, batch: pa.RecordBatch, terms: Terms) -> None:
        data, offsets = text_bytes(batch.column("text"))
        words = Words(data, offsets, ALNUM)
        counts = words.counts()
        word, term = terms.find(words)
        row = np.searchsorted(words.first, word, side="right") - 1
        pair, times = np.unique(term * len(counts) + row, return_counts=True)
        self.ids.append(batch.column("doc_id"))
        self.sizes.append(counts)
        self.terms.append(pair // max(len(counts), 1))
        self.places.append(pair % max(len(counts), 1) + self.n_docs)
        self.times.append(times)
        self.n_docs += len(counts)
        self.n_bytes += len(data)

    def row(self, number: int) -> pa.RecordBatch:
        term, place, times = (np.concatenate(c) for c in (self.terms, self.places, self.times))
        order = np.argsort(term, kind="stable")  # documents of a term stay in order
        term, place, times = term[order], place[order], times[order]
        present, begins = np.unique(term, return_index=True)
        ids = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in self.ids])
        whole = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.record_batch({
            "block": pa.array([number], pa.int64()),
            "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64())),
            "sizes": whole(np.concatenate(self.sizes).astype(np.int64), pa.int64()), "terms": whole(present.astype(np.int32), pa.int32()),
            "begins": whole(begins.astype(np.int64), pa.int64()), "places": whole(place.astype(np.int32), pa.int32()),
            "times": whole(times.astype(np.int32), pa.int32())})


def index_blocks(docs: DataFrame, terms: Terms, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row for each block of documents: ids, numbers of terms, and the postings of `terms`."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in slices(batches):
            for at in range(0, batch.num_rows, block_docs):
                block.add(batch.slice(at, block_docs), shared.value)
                if block.n_bytes >= block_bytes or block.n_docs >= block_docs:
                    yield block.row(first + number)
                    number, block = number + 1, _Block()
        if block.n_docs:
            yield block.row(first + number)
        give_back()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(plain.mapInArrow(run, _BLOCK), "term-blocks")


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def length_norms(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 75 + ((75 * size * n_docs) div n_terms)."""
    if n_terms and int(sizes.max(initial=0)) * 75 * n_docs >= 1 << 63:
        return np.array([25 + 75 * int(s) * n_docs // n_terms for s in sizes], np.int64)
    return 25 + 75 * sizes * n_docs // max(n_terms, 1)


class Search:
    """The best documents of each item, block by block; kept for the whole task."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.top = items, weights, n_docs, n_terms, top
        # (score, is null, doc_id) of the best, in order; ids as they are compared.
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [
            (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        self.scored = self.held = 0

    def _keep(self, item: int, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> int:
        old = self.best[item]
        score, null, doc = (np.concatenate(pair) for pair in zip(old, (scores, nulls, ids)))
        order = np.lexsort((doc, null, -score))[: self.top]
        self.best[item] = (score[order], null[order], doc[order])
        return int(score[order[-1]]) if len(order) == self.top else 0

    def block(self, row: dict) -> None:
        ids, nulls = row["ids"], row["nulls"]
        norms = length_norms(row["sizes"], self.n_docs, self.n_terms)
        times, places = row["times"].astype(np.int64), row["places"]
        gains = 1_000_000_000 * times // (1000 * times + 8 * norms[places])
        limits = np.append(row["begins"], len(places))
        slot = np.full(len(self.weights), -1, np.int64)
        slot[row["terms"]] = np.arange(len(row["terms"]))
        highest = np.maximum.reduceat(gains, row["begins"]) if len(places) else np.zeros(0, np.int64)
        for number, (terms, repeats) in enumerate(self.items):
            here = slot[terms]
            worth = self.weights[terms] * repeats
            use = (here >= 0) & (worth > 0)
            if use.any():
                self._item(number, here[use], worth[use], highest, limits, places, gains, ids, nulls)

    def _item(self, number, here, worth, highest, limits, places, gains, ids, nulls) -> None:
        """One item over one block: masks, groups, bounds, exact scores while a bound is high enough."""
        masks = np.zeros((len(ids), -(-len(here) // 64)), np.uint64)
        for bit, k in enumerate(here):
            masks[places[limits[k]:limits[k + 1]], bit // 64] |= np.uint64(1 << (bit % 64))
        held = np.flatnonzero(masks.any(axis=1))
        masks = np.ascontiguousarray(masks[held])
        view = masks[:, 0] if masks.shape[1] == 1 else masks.view([("", np.uint64)] * masks.shape[1])[:, 0]
        distinct, group = np.unique(view, return_inverse=True)
        bits = np.ascontiguousarray(distinct).view(np.uint64).reshape(len(distinct), -1)
        bounds = np.zeros(len(distinct), np.int64)
        for bit, k in enumerate(here):
            has = (bits[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
            bounds += has.astype(np.int64) * (worth[bit] * highest[k])
        order = np.argsort(-bounds, kind="stable")
        members = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=len(distinct))
        begins = np.cumsum(sizes) - sizes
        self.held += len(held)
        floor = int(self.best[number][0][-1]) if len(self.best[number][0]) == self.top else 0
        at, step = 0, self.top
        while at < len(order):
            # Masks that are not safely below, as many as hold about `step` documents.
            last = at + max(1, int(np.searchsorted(np.cumsum(sizes[order[at:at + step]]), step)) + 1)
            chosen = order[at:last]
            chosen = chosen[bounds[chosen] >= max(floor, 1)]
            if not len(chosen):
                break
            take = sizes[chosen]
            inner = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            rows = held[members[np.repeat(begins[chosen], take) + inner]]
            scores = self._scores(rows, here, worth, limits, places, gains, len(ids))
            self.scored += len(rows)
            good = scores >= max(floor, 1)
            if good.any():
                floor = self._keep(number, scores[good], nulls[rows[good]], ids[rows[good]])
            at, step = last, step * 4

    @staticmethod
    def _scores(rows, here, worth, limits, places, gains, n_docs) -> np.ndarray:
        place = np.full(n_docs, -1, np.int32)
        place[rows] = np.arange(len(rows))
        total = np.zeros(len(rows), np.int64)
        for k, weight in zip(here, worth):
            to = place[places[limits[k]:limits[k + 1]]]
            on = to >= 0
            total[to[on]] += weight * gains[limits[k]:limits[k + 1]][on]
        return total

    def rows(self) -> pa.RecordBatch:
        sizes = [len(b[0]) for b in self.best]
        score, null, doc = (np.concatenate([b[k] for b in self.best] or [np.zeros(0)]) for k in range(3))
        return pa.record_batch({
            "item": pa.array(np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)),
            "doc_id": pa.array(doc.astype(np.int64), mask=null.astype(bool)), "score": pa.array(score.astype(np.int64))})


def _arrays(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch as numpy arrays."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "terms", "begins", "places", "times")}
        ids = batch.column("doc_ids")[i].values
        yield row | {"ids": pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "nulls": ids.is_null().to_numpy(zero_copy_only=False)}


def _search_slice(docs: DataFrame, texts: list[str | None], top: int) -> DataFrame:
    """item (place in `texts`), doc_id, score: the best `top` documents of each text."""
    spark = docs.sparkSession
    terms = Terms(texts)
    blocks = index_blocks(docs, terms)
    sized = blocks.select(
        F.size(F.filter("sizes", lambda n: n > 0)).alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("l"))
    n_docs, n_terms = (int(v or 0) for v in sized.agg(F.sum("n"), F.sum("l")).first())
    # As many rows as the slice has terms.
    spread = blocks.select("begins", F.size("places").alias("_all"), F.posexplode("terms").alias("_at", "term"))
    counted = spread.groupBy("term").agg(F.sum(
        F.coalesce(F.get("begins", F.col("_at") + 1), F.col("_all").cast("long")) - F.get("begins", "_at")).alias("df"))
    df = np.zeros(len(terms), np.int64)
    for term, n in counted.collect():
        df[term] = n
    shared = spark.sparkContext.broadcast((terms.items, term_weights(df, n_docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, n_docs, n_terms, top)
        for batch in batches:
            for row in _arrays(batch):
                search.block(row)
        yield search.rows()
        give_back()

    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = blocks.mapInArrow(run, _FOUND).where("score > 0").withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, slice_bytes: int = SLICE_QUERY_BYTES) -> DataFrame:
    """item_id, text, rank, doc_id, score: for each row of (item_id, text) the `top` documents of highest score above 0.

    Equal scores go by ascending doc_id. The items are cut into slices of about `slice_bytes` of text; the driver
    holds one slice at a time.
    """
    spark = docs.sparkSession
    distinct = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = max(1, -(-int(size) // slice_bytes))
    sliced = materialize(distinct.withColumn("_slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)).cast("int")), "queries")
    kind, parts = distinct.schema["item_id"].dataType.simpleString(), []
    for k in range(n_slices):
        queries = sliced.where(F.col("_slice") == k).drop("_slice").toArrow()
        texts = queries.column("text").to_pylist()
        found = _search_slice(docs, texts, top)
        named = spark.createDataFrame(
            pa.table({"_item": pa.array(range(len(texts)), pa.int32()), "item_id": queries.column("item_id"), "text": queries.column("text")}),
            f"_item int, item_id {kind}, text string")
        parts.append(materialize(found.join(named, found.item == F.col("_item")).select("item_id", "text", "rank", "doc_id", "score"), "found"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op12_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(documents(spark, sf_dir), items).select("item_id", "rank", "doc_id", "score")
