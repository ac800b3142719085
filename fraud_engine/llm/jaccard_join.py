"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Documents with one set are a class, and only classes are compared. Sizes are cut into bands such that two
sets that link are in one band or in neighbours, so each set has signatures for two pairs of bands. For a
pair of bands the domain of shingles is cut into parts by a hash, and each part into three pieces; the
signatures of a set are what it holds of two pieces of a part, for every part and every two. Two sets that
differ in d shingles have at most d / 2 parts with two differences or more; in any other part two of the
pieces are equal. So a set that has more than d / 2 parts with two filled pieces or more shares a signature
with its partner that is not of empty pieces. Sets with fewer such parts (small ones, by chance) also have
the signatures of a second cut, and if that fails too, each shingle as a signature; a pair is found if one of the two has
enough.

Signatures go to buckets as blobs, so the shuffle has few rows; what comes out are the distinct lists of
classes that share a signature. In a list the smallest class is paired with each other one, for each class
first with the smallest of all its lists and then with those it is not yet connected with; links are counted
exactly from whole sets, unless a lower bound of the distance (parity bits of the sets) rules them
out. Members of a list that are then still in different components are sifted by that bound, first
against a few of them that cover the others, then all that are left. So a group of near copies costs one pair
for each member, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, id_text, materialize, parts_for
from fraud_engine.llm.components import components
from fraud_engine.llm.textbatch import SPACED, Words, mix, shingles, slices, text_bytes

SHINGLE = 5
#: Sets link from this similarity on, as a fraction of 100.
PERCENT = 80
#: Parts for each shingle of the largest set of a pair of bands. A pair differs in at most 2/9 of it, so at most
#: 1/9 of as many parts have two differences or more.
PARTS_PER_SHINGLE = 0.14
#: Pieces of a part; each signature leaves one of them out.
PIECES = 3
#: Classes with more than this share of all rows send signatures for one document only; there are fewer than
#: 1 / share of them, so they are broadcast.
HOT_SHARE = 1 / 2000
#: Places of the parity bits of a set, at least.
PARITY_BITS = 1024
#: Members of a list that are compared in one task.
BLOCK = 2048
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000

#: Text that a bucket of signatures stands for.
BUCKET_BYTES = 24 << 20

_U = np.uint64


def band_edges(top: int) -> np.ndarray:
    """Sizes at which bands begin; a set links with sets of its own band and its neighbours only."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(edges[-1] * 100 // PERCENT + 1)
    return np.array([*edges, edges[-1] * 100 // PERCENT + 1], np.int64)


_EDGES = band_edges(1 << 40)


class Sets:
    """Distinct shingle hashes of the rows of a batch: `hashes` by `row`, and the place `at` of each row."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        hashes, row = shingles(Words(data, offsets, SPACED), SHINGLE)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        self.hashes, self.row = hashes[new], row[new]
        self.at = np.searchsorted(self.row, np.arange(len(offsets)))
        self.size = np.diff(self.at)

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, _U)
        np.cumsum(values, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit keys of each row's set."""
        return mix(self.sums(mix(self.hashes))), mix(self.sums(mix(self.hashes ^ _U(0x5851F42D4C957F2D))))

    def parity(self) -> list[bytes]:
        """For each of some places, whether an odd number of shingles falls on it.

        There are PARITY_BITS places, or for a large set the power of two from its size on, so that the bits
        of unlike sets of any size differ in many places. Folding the longer of two gives the shorter's places.
        """
        out: list[bytes] = [b""] * len(self.size)
        bits = np.maximum(PARITY_BITS, 1 << np.ceil(np.log2(np.maximum(self.size, 1))).astype(np.int64))
        for n in np.unique(bits):
            rows = np.flatnonzero(bits == n)
            number = np.full(len(self.size), -1)
            number[rows] = np.arange(len(rows))
            own = number[self.row] >= 0
            place = (self.hashes[own] >> _U(20)).astype(np.int64) & (n - 1)
            flat = np.bincount(number[self.row[own]] * n + place, minlength=len(rows) * n) & 1
            packed = np.packbits(flat.reshape(len(rows), n).astype(np.uint8), axis=1)
            for r, b in zip(rows, packed):
                out[r] = b.tobytes()
        return out

    def _of(self, rows: np.ndarray, lower: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures and their rows for the pair of bands that begins with band `lower`, and filled parts."""
        chosen = np.repeat(np.arange(len(rows)), self.size[rows])
        hashes = np.concatenate([self.hashes[self.at[r]:self.at[r + 1]] for r in rows]) if len(rows) else np.zeros(0, _U)
        tops = _EDGES[lower + 2] - 1
        n_parts = (tops * PARTS_PER_SHINGLE).astype(np.int64) + 2
        spread = mix(hashes ^ _U(0xA0761D6478BD642F * (cut + 1) % (1 << 64)))
        part = (spread >> _U(32)) * n_parts[chosen].astype(_U) >> _U(32)
        slot = chosen.astype(_U) << _U(40) | part
        order = np.argsort(slot)
        slot, values, piece = slot[order], mix(hashes[order]), (spread[order] & _U(0xFFFF)) % _U(PIECES)
        begin = np.ones(len(slot), bool)
        begin[1:] = slot[1:] != slot[:-1]
        first = np.flatnonzero(begin)
        index = (slot[first] >> _U(40)).astype(np.int64)
        where = mix((slot[first] & _U((1 << 40) - 1)) * _U(64) + lower[index].astype(_U) + (_U(cut) << _U(62)))
        found, owners, pieces = [], [], np.zeros(len(first), np.int64)
        if len(first):
            whole, counts = np.add.reduceat(values, first), np.diff(np.append(first, len(slot)))
            for k in range(PIECES):
                own = piece == _U(k)
                held = whole - np.add.reduceat(np.where(own, values, _U(0)), first)
                n = np.add.reduceat(own.astype(np.int64), first)
                pieces += n > 0
                some = counts > n
                found.append(mix(held + where + _U(k))[some])
                owners.append(rows[index[some]])
        filled = np.bincount(index[pieces > 1], minlength=len(rows))
        return np.concatenate([*found, np.zeros(0, _U)]), np.concatenate([*owners, np.zeros(0, np.int64)]), filled

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """(signature, row) of all rows that have shingles."""
        rows = np.flatnonzero(self.size)
        band = np.searchsorted(_EDGES, self.size, side="right") - 1
        found, owners = [], []
        for step in (0, 1):
            own = rows[band[rows] >= step]
            for cut in (0, 1):
                signature, owner, filled = self._of(own, band[own] - step, cut)
                found.append(signature)
                owners.append(owner)
                # Sizes a <= b link if their sets differ in at most (a + b) / 9, which is at most the smaller
                # size over 4. For the larger of two it is at most 2/9 of its size; a set may be either.
                differ = self.size[own] // 4 if step == 0 else self.size[own] * 2 // 9
                own = own[filled <= differ // 2]
                if not len(own):
                    break
            if len(own):
                alone = np.concatenate([self.hashes[self.at[r]:self.at[r + 1]] for r in own])
                lower = np.repeat(band[own] - step, self.size[own])
                found.append(mix(alone + mix(lower.astype(_U) + (_U(3) << _U(62)))))
                owners.append(np.repeat(own, self.size[own]))
        return np.concatenate([*found, np.zeros(0, _U)]), np.concatenate([*owners, np.zeros(0, np.int64)])


_SETS = "doc_id long, row_key long, n_shingles long, c1 long, c2 long, parity binary"


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, c1, c2 (keys of the set), parity of every row of (doc_id, row_key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = Sets(batch.column("text"))
            c1, c2 = sets.keys()
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "n_shingles": pa.array(sets.size, pa.int64()),
                "c1": pa.array(c1.view(np.int64)), "c2": pa.array(c2.view(np.int64)),
                "parity": pa.array(sets.parity(), pa.binary())})

    return docs.mapInArrow(run, _SETS)


def _shared_signatures(docs: DataFrame, n_buckets: int, hot: dict[int, int | None]) -> DataFrame:
    """`members` (sorted 64-bit class keys): the lists of classes that share a signature, each list once.

    Near copies share most of their signatures, so there are far fewer lists than signatures.

    A bucket holds signatures as 48 bits and a row number of the slice they came from; its number gives
    further bits. A false match costs a comparison, no more.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k in range(0, batch.num_rows, 1 << 16):
                yield from deal_rows(batch.slice(k, 1 << 16))

    def deal_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = Sets(batch.column("text"))
        c1 = sets.keys()[0].view(np.int64)
        signature, row = sets.signatures()
        if shared.value:
            ids = batch.column("doc_id").to_pylist()
            mute = np.array([c in shared.value and shared.value[c] != i for c, i in zip(c1.tolist(), ids)])
            signature, row = signature[~mute[row]], row[~mute[row]]
        bucket = ((signature >> _U(48)) * _U(n_buckets) >> _U(16)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entry = (signature[order] << _U(16)) | row[order].astype(_U)
        at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        filled = np.flatnonzero(np.diff(at))
        entries, names = [], []
        for b in filled:
            own = entry[at[b]:at[b + 1]]
            used, place = np.unique(own & _U(0xFFFF), return_inverse=True)
            entries.append(((own & ~_U(0xFFFF)) | place.astype(_U)).tobytes())
            names.append(c1[used.astype(np.int64)].tobytes())
        yield pa.record_batch({
            "bucket": pa.array(filled.astype(np.int32)), "entries": pa.array(entries, pa.binary()),
            "classes": pa.array(names, pa.binary())})

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, classes = [], []
        for batch in batches:
            for e, c in zip(batch.column("entries"), batch.column("classes")):
                own = np.frombuffer(e.as_py(), _U)
                sigs.append(own >> _U(16))
                classes.append(np.frombuffer(c.as_py(), np.int64)[(own & _U(0xFFFF)).astype(np.int64)])
        sig, name = np.concatenate(sigs), np.concatenate(classes)
        del sigs, classes
        order = np.argsort(sig)
        sig, name = sig[order], name[order]
        same = sig[1:] == sig[:-1]
        many = np.zeros(len(sig), bool)
        many[1:] |= same
        many[:-1] |= same
        sig, name = sig[many], name[many]
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        again = np.zeros(len(sig), bool)
        again[1:] = (sig[1:] == sig[:-1]) & (name[1:] == name[:-1])
        sig, name = sig[~again], name[~again]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(sig))
        lists = {name[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist()) if j - i > 1}
        lists = sorted(lists)
        for k in range(0, len(lists), 10_000):
            yield pa.record_batch({"members": pa.array(lists[k:k + 10_000], pa.binary())})

    dealt = docs.mapInArrow(deal, "bucket int, entries binary, classes binary")
    return dealt.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(meet, "members binary").distinct()


def _star_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): the smallest class of each list with every other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(m.as_py(), np.int64) for m in batch.column("members")]
            pairs = np.unique(np.concatenate([np.stack([np.full(len(m) - 1, m[0]), m[1:]], axis=1) for m in own] or [np.zeros((0, 2), np.int64)]), axis=0)
            yield pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return lists.mapInArrow(run, "a long, b long").distinct()


def _members(lists: DataFrame) -> DataFrame:
    """(list, c1) of the lists with more than two members; of two, the star pair says all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(m.as_py(), np.int64) for m in batch.column("members")]
            yield pa.record_batch({
                "list": pa.array(np.repeat(batch.column("list").to_numpy(), [len(m) for m in own])),
                "c1": pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))})

    long = lists.where(F.length("members") > 16).select(F.xxhash64("members").alias("list"), "members")
    return long.mapInArrow(run, "list long, c1 long")


def _words(parity: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(p, _U) for p in parity]


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bits (rows of 64-bit words) for fewer places."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _apart(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with these parity bits (64-bit words) and sums of sizes are too far apart to link.

    Sets that link have |A - B| + |B - A| <= (|A| + |B|) (100 - p) / (100 + p), and each differing place of the
    parity bits takes a shingle that only one of them has.
    """
    words = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum(axis=-1) * (100 + PERCENT) > sizes * (100 - PERCENT)


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """For every pair (a, b), whether its sets link: by parity bits if they rule it out, else by the whole sets."""
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_words(batch.column(c).to_pylist()) for c in ("pa", "pb"))
                size = batch.column("size").to_numpy()
                far = np.zeros(batch.num_rows, bool)
                lengths = np.array([len(x) << 32 | len(y) for x, y in zip(a, b)])
                for both in np.unique(lengths):
                    at = np.flatnonzero(lengths == both)
                    far[at] = _apart(np.stack([a[i] for i in at]), np.stack([b[i] for i in at]), size[at])
                yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "far": pa.array(far)})

    bits = classes.select("c1", "n_shingles", "parity")
    judged = materialize(
        pairs.join(bits.toDF("b", "nb", "pb"), "b").join(bits.toDF("a", "na", "pa"), "a")
        .select("a", "b", (F.col("na") + F.col("nb")).alias("size"), "pa", "pb")
        .mapInArrow(bound, "a long, b long, far boolean"), "bounded")
    near = judged.where("not far").select("a", "b")
    return judged.where("far").select("a", "b", F.lit(False).alias("linked")).unionByName(_counted(docs, classes, near))


def _counted(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with `linked`, counted from the whole sets."""
    ids = materialize(
        pairs.select(F.col("a").alias("c1")).union(pairs.select("b")).distinct().join(classes, "c1").select("c1", "doc_id"),
        "compared-ids")
    n_ids = ids.count()
    needed = docs.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id").select("c1", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = Sets(batch.column("text"))
            own = sets.keys()[0].view(np.int64)
            # Another row of the same id, with another text, is not this class.
            right = np.flatnonzero(own == batch.column("c1").to_numpy())
            yield pa.record_batch({
                "c1": batch.column("c1").take(right),
                "held": pa.array([sets.hashes[sets.at[r]:sets.at[r + 1]].tobytes() for r in right], pa.binary())})

    # One exchange by class serves both joins, so the sets are shuffled once, and once more with their pairs.
    held = needed.mapInArrow(run, "c1 long, held binary").dropDuplicates(["c1"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("held_a"), batch.column("held_b")):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())})

    joined = (
        pairs.join(held.select(F.col("c1").alias("b"), F.col("held").alias("held_b")), "b")
        .join(held.select(F.col("c1").alias("a"), F.col("held").alias("held_a")), "a"))
    return joined.select("a", "b", "held_a", "held_b").mapInArrow(count, "a long, b long, linked boolean")


def _sift(rows: DataFrame, cover: bool) -> DataFrame:
    """Pairs (a, b) of one list, of different components, that the parity bound does not rule out, and, in rows of
    their own, every `list` that has such pairs.

    `rows` has list, blocks, c1, component, n_shingles, parity. With `cover`, only pairs with few members that
    together are near all others. A list with many members is compared block against block.
    """
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("c1"), F.col("blocks"))).select("*", other).select(
        F.xxhash64("list", F.least("block", "with"), F.greatest("block", "with")).alias("group"),
        "list", "c1", "component", "n_shingles", "parity", "block")

    def near_pairs(part: pa.RecordBatch) -> np.ndarray:
        name, size, component, side = (part.column(c).to_numpy() for c in ("c1", "n_shingles", "component", "block"))
        words = _words(part.column("parity").to_pylist())
        lengths = np.array([len(w) for w in words])
        # Rows by the length of their bits; most groups have one.
        alike = [(at, np.stack([words[i] for i in at])) for at in (np.flatnonzero(lengths == n) for n in np.unique(lengths))]
        # In a group of two blocks, a pair within one of them has a group of its own.
        mixed = bool((side != side[0]).any())
        covered, found = np.zeros(len(name), bool), []
        for i in range(len(name) - 1):
            if cover and covered[i]:
                continue
            near = component[i + 1:] != component[i]
            for at, bits in alike:
                k = int(np.searchsorted(at, i + 1))
                if k < len(at):
                    near[at[k:] - i - 1] &= ~_apart(bits[k:], words[i], size[at[k:]] + size[i])
            if mixed:
                near &= side[i + 1:] != side[i]
            at = np.flatnonzero(near) + i + 1
            if len(at):
                covered[at] = True
                found.append(np.stack([np.minimum(name[at], name[i]), np.maximum(name[at], name[i])], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the group that may go on

        def settle(parts: list[pa.RecordBatch]) -> list[tuple[int, np.ndarray]]:
            if not parts:
                return []
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            group = whole.column("group").to_numpy()
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            lists = whole.column("list").to_numpy()[begin].tolist()
            made = [(name, near_pairs(whole.slice(i, j - i)))
                    for name, i, j in zip(lists, begin, np.append(begin[1:], len(group))) if j - i > 1]
            return [(name, pairs) for name, pairs in made if len(pairs)]

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("group").to_numpy()
            last = int(np.searchsorted(group == group[-1], True)) if group[0] != group[-1] else 0
            found = []
            if last or (held and held[-1].column("group")[-1].as_py() != group[0]):
                found = settle([*held, batch.slice(0, last)] if last else held)
                held = [batch.slice(last)]
            else:
                held.append(batch)
            yield from emit(found)
        yield from emit(settle(held))

    def emit(found: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            pairs = np.unique(np.concatenate([p for _, p in found]), axis=0)
            names = np.unique([name for name, _ in found])
            yield pa.record_batch({
                "a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "list": pa.nulls(len(pairs), pa.int64())})
            yield pa.record_batch({
                "a": pa.nulls(len(names), pa.int64()), "b": pa.nulls(len(names), pa.int64()), "list": pa.array(names)})

    placed = dealt.repartition("group").sortWithinPartitions("group", "c1")
    return placed.mapInArrow(run, "a long, b long, list long").distinct()


def _apart_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that are in different components by what is known, and not compared yet."""
    label = components(known.where("linked").select("a", "b"))
    a, b = label.toDF("a", "_ca"), label.toDF("b", "_cb")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(
        F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b").join(known.select("a", "b"), ["a", "b"], "left_anti")


def row_key() -> F.Column:
    """What tells rows apart inside this operator, whether they have an id or not: rows alike in id and text share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, row_key, component of every row.

    A null or empty text has no shingles and links with nothing: its component is its own id. Rows of one id with
    different texts are different documents. A row without id links like any other; its component_id is the smallest id
    that is reached, null if none is. `component` names the component by one of its sets, null without shingles.
    """
    whole = id_text(docs).withColumn("row_key", row_key())
    sets = materialize(shingle_sets(whole.select("doc_id", "row_key", "text")), "shingle-sets")
    # From here on rows go by their key.
    docs = whole.select(F.col("row_key").alias("doc_id"), "text")
    filled = sets.where("n_shingles > 0")
    classes = materialize(
        filled.groupBy("c1", "c2", "n_shingles").agg(
            F.min("row_key").alias("doc_id"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"),
            F.first("parity").alias("parity")), "classes")
    total = sets.count()
    hot = {
        r["c1"]: r["doc_id"] for r in
        classes.where((F.col("rows") > 1) & (F.col("rows") > total * HOT_SHARE)).select("c1", "doc_id").collect()}
    lists = materialize(_shared_signatures(docs, parts_for(docs, BUCKET_BYTES, least=2), hot), "shared-signatures")
    stars = materialize(_star_pairs(lists), "star-pairs")
    # Each class with the smallest of all it shares a list with: one pair a class, which joins most near copies.
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    known = materialize(_linked(docs, classes, first), "compared")
    left = materialize(_apart_pairs(stars, known), "star-pairs-left")
    known = known.unionByName(materialize(_linked(docs, classes, left), "compared-stars"))
    members = materialize(_members(lists), "members")
    for cover in (True, False):
        label = components(known.where("linked").select("a", "b")).withColumnRenamed("node", "c1")
        named = members.join(label, "c1", "left").withColumn("component", F.coalesce("component", "c1"))
        # Lists whose members are not all in one component.
        still_open = named.groupBy("list").agg(
            F.min("component").alias("_x"), F.max("component").alias("_y"),
            F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("_x <> _y").select("list", "blocks")
        rows = named.join(still_open, "list").join(classes.select("c1", "n_shingles", "parity"), "c1")
        sifted = materialize(_sift(rows, cover), "sifted")
        pairs = sifted.where("a is not null").select("a", "b").join(known.select("a", "b"), ["a", "b"], "left_anti")
        more = materialize(_linked(docs, classes, materialize(pairs, "to-compare")), "compared-again")
        known = known.unionByName(more)
        # A list of which no pair is near stays as it is.
        members = members.join(sifted.where("list is not null").select("list"), "list", "left_semi")
    label = components(known.where("linked").select("a", "b"))
    of_class = classes.join(label.withColumnRenamed("node", "c1"), "c1", "left").select(
        "c1", "c2", "n_shingles", "least_id", F.coalesce("component", "c1").alias("component"))
    least = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = of_class.join(least, "component").select("c1", "c2", "n_shingles", "component_id", "component")
    return sets.select("doc_id", "row_key", "n_shingles", "c1", "c2").join(named, ["c1", "c2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "row_key", "component")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each document's set and the smallest id that its links reach."""
    return link_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
