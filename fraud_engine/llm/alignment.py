"""Alignment of two tokenizers over the same bytes, by diagonal run skipping.

A text becomes two sorted arrays: the byte offsets where tokens of A and of B end. Offsets in both cut the tokens
into groups. A cursor stands at one token of each array; their difference is its shift. At the shift, ends are
compared in probes of 1, 2, 4, ... tokens; as far as they agree, tokens are one-to-one and the cursor jumps
over them. Where they differ, the side whose token ends first advances until both end together: an irregular group,
which gives the new shift. Many cursors move at once as numpy arrays, one for each document of a batch and one
more for each stretch of `STRETCH` tokens of a long document, placed on an end that both arrays hold.

Two tokens are linked where their bytes overlap. How often two ids are linked in the whole corpus is counted from the
distinct id pairs of each block of documents; the counts go back to the blocks that hold the pair, so neither
driver nor executor ever holds the table of all pairs.

A text is encoded with one space in front (the second tokenizer adds it by itself), without special tokens, whose
strings are plain text. Null and empty texts, and texts whose bytes one of the tokenizers does not give back,
have no tokens: all zeros and an empty list of groups. Rows of one id, and rows that are alike, are separate
documents, each counted. A null id is an id. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, materialize
from fraud_engine.llm.textbatch import give_back, range_hashes, slices, text_bytes
from fraud_engine.llm.tokens import piece_starts

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Tokens between two cursors of one document.
STRETCH = 512
#: Bytes of text in one block.
BLOCK_BYTES = 16 << 20
#: Chunks whose ids a process remembers; beyond it, it starts anew.
KNOWN_CHUNKS = 1_000_000


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (size[0] of them), begin[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Chunks:
    """Ids of chunks of bytes that a tokenizer never merges across; each distinct chunk is encoded once."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.data, self.data_ends = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.ids, self.id_ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Where the chunks are remembered, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def _learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        found = self.encode([data[a:b].tobytes().decode() for a, b in zip(begin, end)])
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))
        number = len(self.data_ends) + np.arange(len(keys))
        self.data_ends = np.append(self.data_ends, len(self.data) + np.cumsum(end - begin))
        self.data = np.append(self.data, data[ragged(begin, end - begin)])
        self.id_ends = np.append(self.id_ends, len(self.ids) + np.cumsum(size))
        self.ids = np.append(self.ids, ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, number)

    def of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids for each chunk) of data[begin:end]."""
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.keys) > KNOWN_CHUNKS:
            self.forget()
        keys = range_hashes(data, begin, end)
        distinct, sample = np.unique(keys, return_index=True)
        new = self._slot(distinct) < 0
        if new.any():
            self._learn(distinct[new], data, begin[sample[new]], end[sample[new]])
        slot = self._slot(keys)
        size = end - begin
        held = self.data_ends[slot] - np.diff(self.data_ends, prepend=0)[slot]
        if (np.diff(self.data_ends, prepend=0)[slot] != size).any() or (self.data[ragged(held, size)] != data[ragged(begin, size)]).any():
            # Two chunks of one hash: these are encoded without memory.
            found = self.encode([data[a:b].tobytes().decode() for a, b in zip(begin, end)])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum())), counts
        counts = np.diff(self.id_ends, prepend=0)[slot]
        return self.ids[ragged(self.id_ends[slot] - counts, counts)], counts


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    _made: dict[tuple[str, str], Pair] = {}

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(byte_level)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("pieces of this model cross spaces")
        if max(len(names), a.get_vocab_size()) > _LOW:
            raise ValueError("ids of more than 20 bits")
        self.a = Chunks(lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)])
        # A chunk begins with a space, which the model puts there by itself, but not if nothing follows.
        lone = b.encode("a ")[len(b.encode("a")):]
        self.b = Chunks(lambda texts: [
            ids if text != " " else lone for text, ids in zip(texts, b.encode([t[1:] for t in texts], num_threads=1))])
        self.a_bytes = _table([_byte_level(p) for p in _names(a)])
        self.b_bytes = _table([bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                               for i, p in enumerate(names)])

    @classmethod
    def of(cls, byte_level: str, pieces: str) -> Pair:
        """One for each process, so later tasks find the chunks of earlier ones."""
        key = (byte_level, pieces)
        if key not in cls._made:
            cls._made[key] = cls(byte_level, pieces)
        return cls._made[key]


def _names(tokenizer) -> list[str]:
    vocabulary = json.loads(tokenizer.to_str())["model"]["vocab"]
    names = [""] * (max(vocabulary.values()) + 1)
    for name, i in vocabulary.items():
        names[i] = name
    return names


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others follow one another from code point 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_BYTES = _byte_of()


def _byte_level(name: str) -> bytes:
    return bytes(_BYTES[c] for c in name) if all(c in _BYTES for c in name) else name.encode()


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, where a value begins, its size)."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size


class Encoded:
    """Tokens of a batch: `data` with a space before each text, where texts begin, and for A and B the ids and the
    places where tokens end. Texts that do not come back have no bytes here."""

    def __init__(self, texts: pa.Array, pair: Pair):
        plain = texts.fill_null("")
        data, offsets = text_bytes(plain)
        self._fill(data, offsets, np.diff(offsets) > 0)
        good = self._encode(pair)
        if not good.all():
            self._fill(data, offsets, good)
            if not self._encode(pair).all():
                raise AssertionError("a text that came back does not come back alone")

    def _fill(self, data: np.ndarray, offsets: np.ndarray, use: np.ndarray) -> None:
        """Lay out the texts in use, each behind a space."""
        size = np.where(use, np.diff(offsets) + 1, 0)
        self.begin = np.concatenate([[0], np.cumsum(size)])
        self.data = np.full(self.begin[-1], 32, np.uint8)
        rows = np.flatnonzero(use)
        self.data[ragged(self.begin[rows] + 1, size[rows] - 1)] = data[ragged(offsets[rows], size[rows] - 1)]

    def _encode(self, pair: Pair) -> np.ndarray:
        """Encode, and tell which texts both tokenizers give back byte by byte."""
        rows = np.flatnonzero(np.diff(self.begin))
        starts = self.begin[rows]
        lead = np.flatnonzero((self.data & 0xC0) != 0x80)
        points = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        a_begin = lead[piece_starts(points, np.searchsorted(lead, starts))] if len(lead) else np.zeros(0, np.int64)
        blank = self.data == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[starts] = True
        b_begin = np.flatnonzero(cut)
        good = np.ones(len(self.begin) - 1, bool)
        for side, begin, chunks, (table, place, length) in (
                ("a", a_begin, pair.a, pair.a_bytes), ("b", b_begin, pair.b, pair.b_bytes)):
            ids, counts = chunks.of(self.data, begin, np.append(begin[1:], len(self.data)))
            row = np.searchsorted(self.begin, begin, side="right") - 1
            n = np.bincount(row, weights=counts, minlength=len(good)).astype(np.int64)
            size = length[ids]
            per_text = np.bincount(np.repeat(np.arange(len(n)), n), weights=size, minlength=len(good)).astype(np.int64)
            good &= per_text == np.diff(self.begin)
            first = np.concatenate([[0], np.cumsum(n)])
            if good.all():
                back = table[ragged(place[ids], size)]
                wrong = np.flatnonzero(back != self.data)
                good[np.searchsorted(self.begin, wrong, side="right") - 1] = False
            else:  # the layout no longer fits, so text by text
                for r in np.flatnonzero(good & (np.diff(self.begin) > 0)):
                    own = ids[first[r]:first[r + 1]]
                    good[r] = np.array_equal(table[ragged(place[own], size[first[r]:first[r + 1]])], self.data[self.begin[r]:self.begin[r + 1]])
            setattr(self, f"{side}_ids", ids)
            setattr(self, f"{side}_first", first)
            setattr(self, f"{side}_ends", np.cumsum(size))
        return good & (np.diff(self.begin) > 0) if not good.all() else good


def _cursors(e: Encoded) -> tuple[np.ndarray, ...]:
    """(a, b, last a) of each cursor: the start of each text, and inside long ones ends that both sides hold."""
    first, last = e.a_first[:-1], e.a_first[1:]
    count = np.where(last > first, np.maximum((last - first) // STRETCH, 1), 0)
    rows = np.repeat(np.arange(len(first)), count)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    a = first[rows] + step * STRETCH
    inner = np.flatnonzero(step > 0)
    # From the wanted token on, the first one whose start is an end of B; a text's last end always is.
    looking = inner
    while len(looking):
        ends = e.a_ends[a[looking] - 1]
        at = np.searchsorted(e.b_ends, ends)
        missed = e.b_ends[at] != ends
        looking = looking[missed]
        a[looking] += 1
    keep = np.ones(len(a), bool)
    keep[inner] = (a[inner] < last[rows[inner]]) & (a[inner] > a[inner - 1])
    a, rows = a[keep], rows[keep]
    b = e.b_first[rows].copy()
    inside = a > first[rows]
    b[inside] = np.searchsorted(e.b_ends, e.a_ends[a[inside] - 1]) + 1
    stop = np.append(a[1:], len(e.a_ends))
    return a, b, stop


def align(e: Encoded) -> tuple[np.ndarray, np.ndarray]:
    """For each group in order, the number of the A token and of the B token that end it."""
    a, b, stop = _cursors(e)
    size = np.ones(len(a), np.int64)
    out_a, out_b = [], []
    far = np.iinfo(np.int64).max
    while len(a):
        # Ends at the shift of each cursor, as many as its probe has. Beyond the arrays nothing agrees.
        probe = np.minimum(size, stop - a)
        i, j = ragged(a, probe), ragged(b, probe)
        inside = j < len(e.b_ends)
        agree = np.zeros(len(i), bool)
        agree[inside] = e.a_ends[i[inside]] == e.b_ends[j[inside]]
        begin = np.cumsum(probe) - probe
        run = np.minimum(np.minimum.reduceat(np.where(agree, far, np.arange(len(i)) - np.repeat(begin, probe)), begin), probe)
        out_a.append(ragged(a, run))
        out_b.append(ragged(b, run))
        a, b = a + run, b + run
        whole = run == probe
        size = np.where(whole, 2 * size, 1)
        odd = np.flatnonzero(~whole)
        if len(odd):
            i, j, moving = a[odd], b[odd], np.arange(len(odd))
            while len(moving):
                ahead = e.a_ends[i[moving]] < e.b_ends[j[moving]]
                i[moving[ahead]] += 1
                j[moving[~ahead]] += 1
                moving = moving[e.a_ends[i[moving]] != e.b_ends[j[moving]]]
            out_a.append(i)
            out_b.append(j)
            a[odd], b[odd] = i + 1, j + 1
        go = a < stop
        a, b, stop, size = a[go], b[go], stop[go], size[go]
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last_a, last_b = np.concatenate(out_a), np.concatenate(out_b)
    order = np.argsort(last_a, kind="stable")
    return last_a[order], last_b[order]


def links(e: Encoded, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the A and the B token of each link, in order of the bytes that they share.

    A group of one token each is one link. Inside another group, each piece between neighbouring ends of either
    side lies in one token of A and one of B, and no two pieces lie in the same two.
    """
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    single = (n_a == 1) & (n_b == 1)
    odd = np.flatnonzero(~single)
    a = ragged(last_a[odd] - n_a[odd] + 1, n_a[odd])
    b = ragged(last_b[odd] - n_b[odd] + 1, n_b[odd])
    a_ends, b_ends = e.a_ends[a], e.b_ends[b]
    pieces = np.union1d(a_ends, b_ends)
    link_a = np.concatenate([last_a[single], a[np.searchsorted(a_ends, pieces)] if len(odd) else a])
    link_b = np.concatenate([last_b[single], b[np.searchsorted(b_ends, pieces)] if len(odd) else b])
    order = np.argsort(link_a + link_b, kind="stable")
    return link_a[order], link_b[order]


class _Decimals:
    """Numbers as text, by table."""

    def __init__(self, n: int):
        texts = [str(i).encode() for i in range(n)]
        self.size = np.fromiter(map(len, texts), np.int64, n)
        self.width = int(self.size.max())
        self.table = np.frombuffer(b"".join(t.ljust(self.width + 1, b"\0") for t in texts), np.uint8).reshape(n, -1)


_decimals: list[_Decimals] = []


def group_texts(e: Encoded, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of `a1,a2|b1;a3|b2,b3` of all texts one behind the other, each with a ; at its end, and their places."""
    if not _decimals:
        _decimals.append(_Decimals(1 << 17))
    known = _decimals[0]
    # A token of A goes before its group's tokens of B, a group before the next one.
    group_a = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=-1))
    group_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=-1))
    b_before = np.concatenate([[0], last_b + 1])[:-1]
    ids = np.empty(len(e.a_ids) + len(e.b_ids), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    at_a = np.arange(len(e.a_ids)) + b_before[group_a]
    at_b = np.arange(len(e.b_ids)) + (last_a + 1)[group_b]
    ids[at_a], ids[at_b] = e.a_ids, e.b_ids
    mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
    size = known.size[ids]
    rows = known.table[ids]
    rows[np.arange(len(ids)), size] = mark
    flat = rows[np.arange(known.width + 1) <= size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    return flat, ends[e.a_first + e.b_first]


_ROWS = "block long, doc_ids array<long>, docs binary, pairs binary, first binary, pair_no binary, times binary"
_PAIRS = "block long, pair long, n long"
_LOW = (1 << 20) - 1
_COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]
_OUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _pack(values: np.ndarray) -> pa.Array:
    """One value of bytes: 32-bit numbers as differences, in byte planes, compressed."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    planes = np.ascontiguousarray(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.array([zstandard.ZstdCompressor(level=1).compress(planes.tobytes())], pa.binary())


def _unpack(content: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(content), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32).astype(np.int64)


class _Block:
    """What the first pass keeps of a block: numbers of each document, and its distinct id pairs with their links."""

    def __init__(self):
        self.ids, self.numbers, self.hashes, self.pairs, self.n, self.times = [], [], [], [], [], []
        self.n_bytes = 0

    def add(self, batch: pa.RecordBatch, pair: Pair) -> None:
        e = Encoded(batch.column("text"), pair)
        last_a, last_b = align(e)
        text, places = group_texts(e, last_a, last_b)
        content = text.tobytes()
        self.hashes += [
            hashlib.sha256(content[s:t - 1]).hexdigest() if t > s else "" for s, t in zip(places[:-1].tolist(), places[1:].tolist())]
        link_a, link_b = links(e, last_a, last_b)
        n_rows = batch.num_rows
        n_a, n_b = np.diff(e.a_first), np.diff(e.b_first)
        n_groups = np.bincount(np.searchsorted(e.a_first, last_a, side="right") - 1, minlength=n_rows)
        # Every end of either side ends a link, common ends one.
        n_links = n_a + n_b - n_groups
        self.ids.append(batch.column("doc_id"))
        self.numbers.append(np.stack([n_a, n_b, n_groups, n_links]))
        # Row, A id, B id in one number: a batch has far fewer than 2^23 rows.
        row = np.repeat(np.arange(n_rows), n_links)
        found, times = np.unique(row << 40 | e.a_ids[link_a].astype(np.int64) << 20 | e.b_ids[link_b], return_counts=True)
        self.pairs.append((found >> 20 & _LOW) << 32 | found & _LOW)
        self.n.append(np.bincount(found >> 40, minlength=n_rows))
        self.times.append(times)
        self.n_bytes += len(e.data) + n_rows

    def row(self, number: int) -> pa.RecordBatch:
        distinct, pair_no = np.unique(np.concatenate(self.pairs), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(np.concatenate(self.n))])
        ids = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in self.ids])
        packed = lambda values: pa.array([values.tobytes()], pa.binary())
        digests = np.array(self.hashes, "S64")
        return pa.record_batch({
            "block": pa.array([number], pa.int64()),
            "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64())),
            "docs": packed(np.concatenate([np.concatenate(self.numbers, axis=1).astype("<i8").view(np.uint8).ravel(), digests.view(np.uint8).ravel()])),
            "pairs": packed(distinct.astype("<i8")), "first": packed(first.astype("<i8")),
            "pair_no": _pack(pair_no), "times": _pack(np.concatenate(self.times))})


def aligned_blocks(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of documents: their numbers, and which id pairs each document links how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first, number, block = Pair.of(byte_level, pieces), TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in slices(batches):
            block.add(batch, pair)
            if block.n_bytes >= block_bytes:
                yield block.row(first + number)
                number, block = number + 1, _Block()
        if block.ids:
            yield block.row(first + number)
        give_back()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(plain.mapInArrow(run, _ROWS), "aligned-blocks")


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): the links of each distinct id pair of each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = np.frombuffer(batch.column("pairs")[i].as_py(), "<i8")
                at, times = (_unpack(batch.column(c)[i].as_py()) for c in ("pair_no", "times"))
                n = np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64)
                yield pa.record_batch({
                    "block": pa.array(np.full(len(pairs), batch.column("block")[i].as_py(), np.int64)),
                    "pair": pa.array(pairs.astype(np.int64)), "n": pa.array(n)})

    return blocks.select("block", "pairs", "pair_no", "times").mapInArrow(run, _PAIRS)


def pair_counts(block_pairs: DataFrame) -> DataFrame:
    """pair, count, best of every linked id pair; `best` where no pair of the same B id has a higher count."""
    counted = block_pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    b_id = Window.partitionBy("_b")
    # At most as many rows for one B id as the first vocabulary has ids.
    return counted.withColumn("_b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).select(
        "pair", "count", (F.col("count") == F.max("count").over(b_id)).alias("best"))


def _sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Numbers of the documents of one block, from its row and the counts of its pairs."""
    out = []
    for i in range(left.num_rows):
        ids = left.column("doc_ids")[i].values
        n_docs = len(ids)
        head = np.frombuffer(left.column("docs")[i].as_py(), np.uint8)
        numbers = head[: 32 * n_docs].view("<i8").reshape(4, n_docs) if n_docs else np.zeros((4, 0), np.int64)
        hashes = head[32 * n_docs:].view("S64")
        at, times = (_unpack(left.column(c)[i].as_py()) for c in ("pair_no", "times"))
        first = np.frombuffer(left.column("first")[i].as_py(), "<i8")
        order = pc.sort_indices(right, [("pair", "ascending")])
        count, best = (right.column(c).take(order).to_numpy() for c in ("count", "best"))
        sums = [np.concatenate([[0], np.cumsum(times * v[at].astype(np.int64))]) for v in (best, count)]
        out.append(pa.table({
            "doc_id": ids, **{c: pa.array(n.astype(np.int64)) for c, n in zip(_COLUMNS, numbers)},
            "n_best": pa.array(sums[0][first[1:]] - sums[0][first[:-1]]), "count_sum": pa.array(sums[1][first[1:]] - sums[1][first[:-1]]),
            "groups_sha256": pa.array([h.decode() for h in hashes.tolist()], pa.string())}))
    return pa.concat_tables(out) if out else pa.table({
        f.split()[0]: pa.array([], pa.string() if "string" in f else pa.int64()) for f in _OUT.split(", ")})


def align_corpus(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    `n_best` counts the links whose id pair has the highest count of its B id in the corpus, `count_sum` adds up the
    counts of all links.
    """
    blocks = aligned_blocks(docs, byte_level, pieces, block_bytes)
    found = materialize(_block_pairs(blocks), "block-pairs")
    counts = materialize(pair_counts(found), "pair-counts")
    known = found.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    kept = blocks.select("block", "doc_ids", "docs", "first", "pair_no", "times")
    return kept.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_sums, _OUT)


def op11_diagonal_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(documents(spark, sf_dir))
