"""Arrow batches of texts as byte arrays: slices of bounded size, words, and word and n-gram hashes.

Everything here works on one Arrow batch inside a task. A hash is a pair of polynomials over the bytes modulo
the prime 2^31 - 1, each with its own base and a random value for each byte value, then mixed; all processes
agree on them. (Modulo a power of two, words that swap two letters in the Thue-Morse pattern would collide
whatever the base.)
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; a longer text is handled alone, and whole.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_PRIME = (1 << 31) - 1
_P = _U(_PRIME)
_SEEDS = np.random.default_rng(20240607)
_BASES = [int(b) for b in _SEEDS.integers(1 << 20, _PRIME, 2)]
_BYTE_VALUES = _SEEDS.integers(1, _PRIME, (2, 256), dtype=np.int64).astype(_U)
# For each of the two bases its powers, and those of its inverse.
_powers: dict[int, np.ndarray] = {}

#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words between the six ASCII white-space bytes.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Words of digits, letters a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _forget_powers() -> None:
    _powers.clear()


def _fold(x: np.ndarray) -> np.ndarray:
    """The same values modulo the prime; below 2^34 for any 64-bit value, below 2^32 for a product."""
    return (x & _P) + (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base^i modulo the prime for i < n."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(1, -(-n // (1 << 19))) << 19
        known = np.empty(size, np.uint32)
        known[0], have = 1, 1
        while have < size:
            step = min(have, size - have)
            known[have:have + step] = known[:step].astype(_U) * _U(pow(base, have, _PRIME)) % _P
            have += step
        _powers[base] = known
    return known[:n]


def _reduce(x: np.ndarray) -> np.ndarray:
    """`x` modulo the prime in place, for values below the square of the prime."""
    high = x >> _U(31)
    x &= _P
    x += high
    # Below the prime the difference wraps to a large number.
    return np.minimum(x, np.subtract(x, _P, out=high), out=x)


def prefix_sums(data: np.ndarray) -> list[np.ndarray]:
    """What the hashes of ranges of `data` are taken from; give it to more than one of them."""
    found, place = [], data.astype(np.intp)
    for base, value in zip(_BASES, _BYTE_VALUES):
        sums = np.zeros(len(data) + 1, _U)
        terms = value.take(place, mode="clip")
        terms *= _power(base, len(data))
        high = terms >> _U(31)
        terms &= _P
        terms += high
        np.cumsum(terms, out=sums[1:])
        found.append(sums)
    return found


def _ranges(sums: list[np.ndarray], start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """62 bits for the bytes of each range, the same for the same bytes at any place."""
    halves = []
    for base, own in zip(_BASES, sums):
        back = _power(pow(base, -1, _PRIME), len(own))[start]
        half = _reduce(_fold(own[end] - own[start]))
        half *= back
        halves.append(_reduce(half))
    halves[0] <<= _U(31)
    halves[0] |= halves[1]
    return halves[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit value; a bijection."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 places where its rows begin; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return memory that arrays no longer use; a Python worker lives on and runs other operators' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of `column`, or of one row."""
    _forget_powers()
    give_back()
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        give_back()


class Words:
    """Words of a batch of texts: `start` and `end` in `data`, `first` word of each row (n+1 places)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data = LOWER[data]
        inside = kind[self.data]
        begins, stops = inside.copy(), inside.copy()
        if len(inside):
            begins[1:] &= ~inside[:-1]
            stops[:-1] &= ~inside[1:]
            edges = offsets[:-1][offsets[:-1] < len(inside)]
            begins[edges] = inside[edges]
            last = offsets[1:][offsets[1:] > 0] - 1
            stops[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        return mix(_ranges(prefix_sums(self.data), self.start, self.end))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n-1 places are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.full(m, n, _U)
    for j in range(n):
        out = mix(out * _BASE + hashes[j:j + m])
    return out


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each n-word shingle; a row of fewer words, but not none, is one shingle."""
    hashes, counts = words.hashes(), words.counts()
    rows = np.repeat(np.arange(len(counts)), counts)
    grams = ngrams(hashes, n)
    whole = rows[: len(grams)] == rows[n - 1:] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], rows[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        alone = np.array([ngrams(hashes[words.first[r]:words.first[r + 1]], int(counts[r]))[0] for r in short], _U)
        grams, owner = np.concatenate([grams, alone]), np.concatenate([owner, short])
    return grams, owner


def window_hashes(data: np.ndarray, width: int, sums: list[np.ndarray] | None = None) -> np.ndarray:
    """Rolling hash of the `width` bytes from each byte on; the last width-1 places are left out."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    return mix(_ranges(prefix_sums(data) if sums is None else sums, slice(0, n), slice(width, None)))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: list[np.ndarray] | None = None) -> np.ndarray:
    """Hash of the bytes of each range."""
    return mix(_ranges(prefix_sums(data) if sums is None else sums, start, end) + ((end - start).astype(_U) << _U(62)))
