"""Token ids of texts by a public byte-level BPE, and the file format that stores them.

Encoding. The vocabulary's own pattern cuts a text into pieces, and merges never cross a piece. The pieces of
a batch are found and hashed as arrays, each distinct one is encoded once by the tokenizers library and
remembered. A text that holds the string of a special token is encoded whole by the library.

File format ("planes"). Ids are cut into blocks of `BLOCK_IDS`. A block is transposed into its four
byte planes (or 32 bit planes), each plane is compressed by zstandard, and an index at the end of the
file gives for each block its place, its ids and the length of every plane, and for each document its
id, first id and number of ids.

    magic "IDPLANES" | planes of block 0, 1, ... | index (zstandard of JSON) | its length, 8 bytes
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraud_engine.llm.common import documents, id_text, materialize, parts_for, run_folder
from fraud_engine.llm.ordered import in_order
from fraud_engine.llm.textbatch import range_hashes, slices, text_bytes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
BLOCK_IDS = 1 << 16
#: Pieces that a process remembers, about 40 bytes each; beyond it, it starts anew.
KNOWN_PIECES = 1_500_000
#: Bytes of text that go to one file.
FILE_BYTES = 8 << 20
MAGIC = b"IDPLANES"


_SPACE_CLASS, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, other."""
    if not _classes:
        import regex

        points = np.arange(0x110000, dtype=np.uint32)
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        found = np.full(0x110000, _OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE_CLASS)):
            found[[m.start() for m in regex.finditer(pattern, text)]] = kind
        _classes.append(found)
    return _classes[0]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of the vocabulary's pattern begin, in code points; rows begin at `first`.

    A piece is a run of letters, of numbers or of other characters with one space before it, or a run of
    white space without its last character if something follows; 's 't 're 've 'm 'll 'd are pieces
    where they do not follow other characters or a space.
    """
    kind = char_classes()[points]
    n = len(points)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    row_end = begins.copy()  # at place i: a row begins at i, or the texts end
    row_end[n] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | row_end[1:n]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (points[:-1] == 32) & ~row_end[1:n]
    word = kind != _SPACE_CLASS
    starts = change & ~(word & after_blank)
    # The last white space before something else.
    last = np.zeros(n, bool)
    last[:-1] = ~word[:-1] & word[1:] & ~row_end[1:n]
    starts |= last
    for i in np.flatnonzero((points == 39) & starts):
        tail = points[i + 1:i + 3].tobytes().decode("utf-32-le", "replace")
        size = 1 if tail[:1] and tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
        if size and not row_end[i + 1:i + 1 + size].any():
            starts[i + 1] = False
            if i + 1 + size < n:
                starts[i + 1 + size] = True
    return np.flatnonzero(starts)


class Encoder:
    """Texts to ids by the tokenizers library, which is asked once for each distinct piece."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        # By sorted hash: where the ids of a piece begin and how many there are.
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each process, so later tasks find the pieces of earlier ones."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))
        begin = size.cumsum() - size + len(self.ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = (
            np.insert(old, at, new) for old, new in ((self.keys, keys), (self.begin, begin), (self.size, size)))
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by the end id, and the n+1 places where the texts begin; null is empty."""
        plain = texts.fill_null("")
        whole = {}
        data, offsets = text_bytes(plain)
        if any(data.tobytes().find(s.encode()) >= 0 for s in self.special):
            rows = plain.to_pylist()
            whole = {r: t for r, t in enumerate(rows) if any(s in t for s in self.special)}
            data, offsets = text_bytes(pa.array(["" if r in whole else t for r, t in enumerate(rows)], pa.large_string()))
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(lead, offsets)
        starts = piece_starts(points, first[:-1])
        begin = lead[starts]
        end = np.append(begin[1:], len(data))
        keys = range_hashes(data, begin, end)
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        distinct, sample = keys[order][new], order[new]
        index = np.empty(len(keys), np.int64)
        index[order] = np.cumsum(new) - 1
        if len(self.keys) > KNOWN_PIECES:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        unknown = np.ones(len(distinct), bool)
        inner = at < len(self.keys)
        unknown[inner] = self.keys[at[inner]] != distinct[inner]
        if unknown.any():
            self._learn(distinct[unknown], [data[begin[i]:end[i]].tobytes().decode() for i in sample[unknown]])
            at = np.searchsorted(self.keys, distinct)
        size, source = self.size[at][index], self.begin[at][index]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, first)))
        total = np.concatenate([[0], np.cumsum(size)])
        n_rows = len(offsets) - 1
        per_row = np.bincount(row, weights=size, minlength=n_rows).astype(np.int64)
        flat = self.ids[np.arange(total[-1]) + np.repeat(source - total[:-1], size)]
        places = np.concatenate([[0], np.cumsum(per_row + 1)])
        out = np.full(places[-1], END_ID, np.uint32)
        out[np.arange(total[-1]) + np.repeat(np.arange(n_rows), per_row)] = flat
        if not whole:
            return out, places
        parts = [out[a:b] for a, b in zip(places[:-1], places[1:])]
        for r, text in whole.items():
            parts[r] = np.array([*self.library.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def byte_planes(ids: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(p).tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def bit_planes(ids: np.ndarray) -> list[bytes]:
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in bits.T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The n ids of 4 byte planes or 32 bit planes."""
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").ravel()[:n]
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").copy().view("<u4").ravel()


class Writer:
    """A file of ids, given document by document."""

    def __init__(self, sink, planes: str = "byte", block_ids: int = BLOCK_IDS):
        self.sink, self.split, self.block_ids = sink, {"byte": byte_planes, "bit": bit_planes}[planes], block_ids
        self.press = zstandard.ZstdCompressor(level=3)
        self.held, self.n_held, self.n_ids, self.at = [], 0, 0, len(MAGIC)
        self.blocks, self.docs = [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, self.n_ids, len(ids)])
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block_ids:
            all_ids = np.concatenate(self.held)
            whole = len(all_ids) // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._block(all_ids[k:k + self.block_ids])
            self.held, self.n_held = [all_ids[whole:]], len(all_ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        parts = [self.press.compress(p) for p in self.split(ids)]
        self.blocks.append([self.at, len(ids), [len(p) for p in parts]])
        for p in parts:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> int:
        """Write what is held and the index; return the length of the file."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        index = self.press.compress(json.dumps({"blocks": self.blocks, "docs": self.docs}).encode())
        self.sink.write(index)
        self.sink.write(len(index).to_bytes(8, "little"))
        return self.at + len(index) + 8


class Reader:
    """The content of a file: its index, any block, the ids of any document."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of id planes")
        size = int.from_bytes(content[-8:], "little")
        self.press = zstandard.ZstdDecompressor()
        index = json.loads(self.press.decompress(content[-8 - size:-8]))
        self.content, self.blocks, self.docs = content, index["blocks"], index["docs"]
        self.firsts = np.cumsum([0] + [b[1] for b in self.blocks])
        self._last = (-1, np.zeros(0, np.uint32))

    def block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            at, n, sizes = self.blocks[k]
            planes = []
            for size in sizes:
                planes.append(self.press.decompress(self.content[at:at + size]))
                at += size
            self._last = (k, from_planes(planes, n))
        return self._last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on; only the blocks that hold them are read."""
        parts, k = [], int(np.searchsorted(self.firsts, start, side="right")) - 1
        while n > 0:
            first = int(self.firsts[k])
            part = self.block(k)[start - first:start - first + n]
            parts.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder that is given as a path or a URI; the folder is made."""
    store, base = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(base, recursive=True)
    return store, base


_MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


def write_ids(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, planes: str = "byte",
              block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode all texts in ascending order of doc_id, one file for each part; return the list of files.

    The list (part, path, n_docs, n_ids, n_bytes, first_id) is as long as there are parts. A null text is
    empty and holds the end id alone; rows of one id follow each other in order of their texts; null ids
    come first. A task writes under a name of its own and renames at the end, so a repeated task leaves
    whole files only.
    """
    whole = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    ordered = in_order(whole, ["doc_id", "text"], parts_for(whole, file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(vocabulary), TaskContext.get().partitionId()
        store, base = open_folder(folder)
        path, writer = f"ids-{part:06d}-{uuid4().hex}.planes", None
        for batch in slices(batches):
            if writer is None:
                sink = store.open_output_stream(f"{base}/{path}.part")
                writer = Writer(sink, planes, block_ids)
            ids, at = encoder.encode(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:]):
                writer.add(doc_id, ids[a:b])
        if writer:
            n_bytes = writer.close()
            sink.close()
            store.move(f"{base}/{path}.part", f"{base}/{path}")
            yield pa.RecordBatch.from_pylist([{
                "part": part, "path": path, "n_docs": len(writer.docs), "n_ids": writer.n_ids, "n_bytes": n_bytes}],
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    files = sorted(map(tuple, materialize(ordered.mapInArrow(run, _MANIFEST), "id-files").collect()))
    rows, first = [], 0
    for part, path, n_docs, n_ids, n_bytes in files:
        rows.append((part, path, n_docs, n_ids, n_bytes, first))
        first += n_ids
    return docs.sparkSession.createDataFrame(rows, f"{_MANIFEST}, first_id long")


_READ = "path string, doc_id long, start long, n_tokens long, ids_crc32 long"


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that `files` lists."""
    spark = files.sparkSession
    listed = files.select("path", "first_id")
    if listed.isEmpty():
        return spark.createDataFrame([], _READ.replace("path string, ", ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                file = Reader(content.as_py())
                crcs = [zlib.crc32(file.ids(s, n).astype("<u4").tobytes()) for _, s, n in file.docs]
                yield pa.record_batch({
                    "path": pa.array([path.rsplit("/", 1)[-1]] * len(crcs), pa.string()),
                    "doc_id": pa.array([d for d, _, _ in file.docs], pa.int64()),
                    "start": pa.array([s for _, s, _ in file.docs], pa.int64()),
                    "n_tokens": pa.array([n for _, _, n in file.docs], pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64())})

    contents = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.planes").load(folder).select("path", "content"))
    read = contents.mapInArrow(run, _READ)
    return read.join(F.broadcast(listed), "path").select(
        "doc_id", (F.col("first_id") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{run_folder(spark)}/id-planes-{uuid4().hex}"
    return read_ids(write_ids(documents(spark, sf_dir), folder), folder)
