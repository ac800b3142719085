"""Second-order boosted trees, grown from histograms that Spark adds up.

Rows are binned once and kept as blocks of bytes. For each level of a tree, every task adds gradients and hessians
of its rows by (node, feature, bin), Spark adds the tasks' sums, and the driver picks the splits; what reaches it is
nodes x features x bins, whatever the number of rows. Of two sister nodes only the lighter one is counted, and of the
bins of a narrow feature, such as a flag, all but the commonest: that one has what they leave of the node's sums. Narrow
features of which no row has two in an uncommon bin, such as the flags of one column, share a byte of the row and are counted
together (exclusive feature bundling, Ke et al. 2017); a block with a row that has two keeps a byte for each feature. The
rows of a node that has at most `gather_rows` of them are sent to one task, which grows all that is below the node, so that
small nodes cost no further passes (as in PLANET, Panda et al. 2009); the splits are the same either way. Where the root is
such a node, the task that gets its rows grows the trees of all rounds up to the next store of margins. A pass has a
fixed cost, so the first one of a tree counts the uppermost levels together, rows dealt as in an earlier tree; where a
node then splits otherwise, the level below it is counted by a pass of its own.

Gradients and hessians are added as whole numbers of fixed size, row and column draws are hashes of row key and
round, so a model depends on rows and settings alone: not on partitions, cores or retries.

A split sends values up to its cut to the left; missing values (null, NaN) go to the side that gains more. A
node's gain is L^2/(HL+l2) + R^2/(HR+l2) - G^2/(H+l2), a leaf's value is -step * G/(H+l2). With validation rows, rounds end
once `patience` of them in a row bring no lower log loss, and the model keeps the rounds up to the best.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import delete_folder, folders_in, local_table, run_folder

NODE_SCHEMA = (
    "tree int, node int, feature string, cut double, missing_left boolean, left int, right int, "
    "value double, gain double, cover double"
)
# Rows of one block: their sums stay whole numbers that a double holds exactly.
BLOCK_ROWS = 1 << 14
_BLOCK_BITS = 14
# Smallest gain that is taken for one.
LEAST_GAIN = 1e-6
# Bins of a feature that is narrow, at most.
NARROW_BINS = 4
# Sums of so many nodes at most reach the driver unadded.
_UNADDED = 256
# Levels of a tree that are counted at once where they split as in an earlier tree.
_GUESSED = 2
# Earlier trees that are looked at for that.
_LOOK_BACK = 20
# Rounds after which margins are brought up to date in the held blocks, where a pass walks the trees since then.
_FRESH = 5
# Times that margins are brought up to date in the held blocks alone before they are written again.
_LINKS = 4
# Bytes of the held blocks of a task, about.
_TASK_BYTES = 1 << 27
_BLOCK = "layout int, n int, bins binary, label binary, role binary, draw binary, margin binary"
_TRAIN, _VALIDATION = 0, 1
# Layouts of a block: features of a bundle share a byte, or each has its own.
_BUNDLED, _PLAIN = 0, 1


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    patience: int = 20
    depth: int = 6
    step: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    least_cover: float = 1.0
    # Bins of a feature at most, one of them for missing values.
    bins: int = 256
    # Rows, the same for the same keys, whose values give the cuts.
    cut_rows: int = 20_000
    seed: int = 42
    # Rounds between two stored states.
    keep_every: int = 10
    # Rows of a node that one task takes over.
    gather_rows: int = 200_000


@dataclass(frozen=True)
class _Layout:
    """Which byte of a row holds a feature, and which bins the values of that byte stand for.

    A byte of one feature is its bin. One of a bundle is 0 where all features of the bundle are in their common bins, else
    it tells the one feature that is not, and its bin.
    """

    column: np.ndarray
    # Of a feature in a bundle: what is added to its bins; -1 for one with a byte of its own.
    base: np.ndarray
    common: np.ndarray
    # (feature, byte) -> bin
    bins: np.ndarray
    # Where the values of each byte lie in a row of sums.
    first: np.ndarray

    @classmethod
    def of(cls, bundles: list[list[int]], common: np.ndarray, widths: np.ndarray) -> _Layout:
        n = len(widths)
        column, base, sizes = np.zeros(n, np.int64), np.full(n, -1), []
        bins = np.tile(np.arange(256, dtype=np.uint8), (n, 1))
        for c, own in enumerate(bundles):
            size = 1
            for f in own:
                column[f] = c
                if len(own) > 1:
                    base[f], bins[f] = size, common[f]
                    bins[f, size:size + widths[f]] = np.arange(widths[f])
                    size += widths[f]
            sizes.append(size if len(own) > 1 else widths[own[0]])
        return cls(column, base, common, bins, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    @classmethod
    def plain(cls, widths: np.ndarray) -> _Layout:
        return cls.of([[f] for f in range(len(widths))], np.zeros(len(widths), np.uint8), widths)

    @classmethod
    def fit(cls, seen: np.ndarray, widths: np.ndarray) -> _Layout:
        """Bundles of narrow features that exclude each other in the rows of `seen` (feature, row)."""
        common, bundles, taken, sizes = np.zeros(len(widths), np.uint8), [], [], []
        for f, width in enumerate(widths):
            if width > NARROW_BINS or not seen.shape[1]:
                bundles.append([f])
                taken.append(None)
                sizes.append(256)
                continue
            common[f] = np.argmax(np.bincount(seen[f], minlength=NARROW_BINS))
            odd = seen[f] != common[f]
            for c, other in enumerate(taken):
                if sizes[c] + width <= 256 and not (other & odd).any():
                    break
            else:
                c = len(bundles)
                bundles.append([])
                taken.append(np.zeros(seen.shape[1], bool))
                sizes.append(1)
            bundles[c].append(f)
            taken[c] |= odd
            sizes[c] += width
        return cls.of(bundles, common, widths)

    def pack(self, bins: np.ndarray) -> np.ndarray | None:
        """(byte, row) from (feature, row); None if two features of a bundle are not in their common bins."""
        out = np.zeros((len(self.first) - 1, bins.shape[1]), np.uint8)
        for f, (c, base) in enumerate(zip(self.column, self.base)):
            if base < 0:
                out[c] = bins[f]
                continue
            odd = np.flatnonzero(bins[f] != self.common[f])
            if out[c].take(odd).any():
                return None
            out[c, odd] = bins[f].take(odd) + np.uint8(base)
        return out

    def unpack(self, held: np.ndarray) -> np.ndarray:
        return np.stack([bins.take(held[c]) for bins, c in zip(self.bins, self.column)])


def _together(pieces: list[tuple[int, np.ndarray]], layouts: tuple[_Layout, _Layout]) -> tuple[np.ndarray, int]:
    """The bytes of (layout, bytes) side by side, and their layout."""
    if len({layout for layout, _ in pieces}) == 1:
        return np.concatenate([b for _, b in pieces], axis=1), pieces[0][0]
    return np.concatenate([layouts[layout].unpack(b) for layout, b in pieces], axis=1), _PLAIN


@dataclass
class Tree:
    """One tree; the children of node i are 2i+1 and 2i+2, feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))

    def steps(self, layout: _Layout) -> tuple[np.ndarray, np.ndarray]:
        """The byte that each node looks at, and the node that follows node and byte, at 256 node + byte."""
        node, feature = np.arange(len(self.feature))[:, None], np.maximum(self.feature, 0)
        bins = layout.bins[feature]
        left = np.where(bins == 0, self.missing_left[:, None], bins <= self.bin[:, None])
        return layout.column[feature], np.where(self.feature[:, None] >= 0, 2 * node + 2 - left, node).ravel()


class _Walks:
    """The steps of some trees, by layout."""

    def __init__(self, trees: list[Tree], layouts: tuple[_Layout, _Layout]):
        self.trees, self.layouts, self.made = trees, layouts, {}

    def of(self, layout: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if layout not in self.made:
            self.made[layout] = [t.steps(self.layouts[layout]) for t in self.trees]
        return self.made[layout]


def _leaf_of(steps: tuple[np.ndarray, np.ndarray], bins: np.ndarray, levels: int, rows: np.ndarray) -> np.ndarray:
    """The node that each column of `bins` (byte, row) in `rows` reaches."""
    feature, follows = steps[0] * bins.shape[1], steps[1]
    node, flat = np.zeros(len(rows), np.int64), bins.ravel()
    for _ in range(levels):
        seen = flat.take(feature.take(node) + rows)
        node = follows.take((node << 8) + seen)
    return node


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _drawn(draw: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Which rows the tree `number` is grown on."""
    if share >= 1:
        return np.ones(len(draw), bool)
    salt = _mix(np.array([seed * 1_000_003 + number + 1], np.uint64))
    return (_mix(draw ^ salt) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _columns(n: int, seed: int, number: int, share: float) -> np.ndarray:
    if share >= 1:
        return np.arange(n)
    return np.sort(np.random.default_rng([seed, number]).permutation(n)[: max(1, int(share * n))])


def _vector(features: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """(row, feature); null is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _cut_rows(df: DataFrame, features: list[str], key: str, settings: Settings) -> np.ndarray:
    """The rows with the lowest hashes of `key`."""
    sample = df.select(F.xxhash64(key).alias("draw"), _vector(features).alias("x")).orderBy("draw").limit(settings.cut_rows)
    table = sample.select("x").toArrow()
    return _matrix(pa.concat_arrays(table.column("x").chunks), len(features)) if table.num_rows else np.zeros((0, len(features)))


def choose_cuts(df: DataFrame, features: list[str], key: str, settings: Settings) -> list[np.ndarray]:
    """For each feature the values after which rows may be split, from the rows with the lowest hashes of `key`."""
    return _cuts_of(_cut_rows(df, features, key, settings), settings)


def _cuts_of(x: np.ndarray, settings: Settings) -> list[np.ndarray]:
    cuts = []
    for column in x.T:
        seen = np.unique(column[~np.isnan(column)])
        if len(seen) > settings.bins - 1:
            known = np.sort(column[~np.isnan(column)])
            seen = np.unique(known[np.linspace(0, len(known) - 1, settings.bins - 1).astype(np.int64)])
        cuts.append(seen[:-1])
    return cuts


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(feature, row) from (row, feature), with bin 0 for missing values."""
    bins = np.empty((len(cuts), len(x)), np.uint8)
    for f, own in enumerate(cuts):
        column = np.ascontiguousarray(x[:, f])
        bins[f] = np.where(np.isnan(column), 0, np.searchsorted(own, column) + 1)
    return bins


def binned(df: DataFrame, features: list[str], key: str, cuts: list[np.ndarray], bundled: _Layout | None = None) -> DataFrame:
    """Blocks of (label, role, x, key), bundled where their rows allow."""
    width = len(features)

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        x = _matrix(pa.concat_arrays(table.column("x").chunks), width)
        plain = _bins(x, cuts)
        bins = None if bundled is None else bundled.pack(plain)
        layout = _PLAIN if bins is None else _BUNDLED
        packed = lambda a: pa.array([a.tobytes()], pa.binary())
        numbers = lambda c, kind: table.column(c).to_numpy().astype(kind)
        return pa.record_batch({
            "layout": pa.array([layout], pa.int32()), "n": pa.array([len(x)], pa.int32()), "bins": packed(plain if bins is None else bins), "label": packed(numbers("label", np.uint8)),
            "role": packed(numbers("role", np.uint8)), "draw": packed(numbers("draw", np.int64)), "margin": packed(np.zeros(len(x)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                if n + piece.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield block(held)

    return df.select(
        _vector(features).alias("x"), F.col(S.LABEL).cast("int").alias("label"), F.col("_role").alias("role"),
        F.xxhash64(key).alias("draw")).mapInArrow(run, _BLOCK)


@dataclass(frozen=True)
class _Block:
    layout: int
    bins: np.ndarray
    label: np.ndarray
    role: np.ndarray
    draw: np.ndarray
    margin: np.ndarray


def _blocks(rows: Iterator[tuple]) -> Iterator[_Block]:
    """The rows are those of _BLOCK."""
    # Spark's workers collect garbage after every task; they need not look through the loaded modules each time.
    if not gc.get_freeze_count():
        gc.freeze()
    for layout, n, bins, label, role, draw, margin in rows:
        yield _Block(
            layout, np.frombuffer(bins, np.uint8).reshape(-1, n), np.frombuffer(label, np.uint8),
            np.frombuffer(role, np.uint8), np.frombuffer(draw, np.uint64), np.frombuffer(margin))


def _loss(label: np.ndarray, margin: np.ndarray, unit: float) -> np.ndarray:
    """Log loss as a whole number of units, and the number of rows."""
    p = 1 / (1 + np.exp(-margin))
    right = np.where(label == 1, p, 1 - p)
    return np.array([int(np.rint(-np.log(np.maximum(right, 1e-16)) * unit).sum()), len(label)], np.int64)


def _widths(cuts: list[np.ndarray]) -> np.ndarray:
    return np.array([len(c) + 2 for c in cuts], np.int64)


def _with_trees(block: _Block, walks: _Walks, depth: int, rows: np.ndarray) -> np.ndarray:
    """The margins of `rows` with the trees of `walks`."""
    margin = block.margin[rows]
    for tree, steps in zip(walks.trees, walks.of(block.layout)):
        margin += tree.value[_leaf_of(steps, block.bins, depth, rows)]
    return margin


@dataclass(frozen=True)
class _Uncommon:
    """Of narrow features, the bins that are not a feature's commonest, row by row: those of row r lie from first[r] to first[r + 1]."""

    features: np.ndarray
    common: np.ndarray
    first: np.ndarray
    place: np.ndarray

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of bins, and which of `rows` each is from."""
        size = self.first[rows + 1] - self.first[rows]
        entry = np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.place[entry].astype(np.int64), np.repeat(np.arange(len(rows)), size)


@dataclass(frozen=True)
class _Grid:
    """Where the bins of the features lie in a row of sums, and how splits are found in it."""

    first: np.ndarray
    unit: float
    settings: Settings

    def uncommon(self, bins: np.ndarray) -> _Uncommon:
        """For rows that are counted many times."""
        features = np.flatnonzero(np.diff(self.first) <= NARROW_BINS)
        common = np.array([np.argmax(np.bincount(bins[f], minlength=NARROW_BINS)) for f in features], np.int64)
        row, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k, f in enumerate(features):
            row.append(np.flatnonzero(bins[f] != common[k]))
            place.append(bins[f].take(row[-1]).astype(np.int32) + k * NARROW_BINS)
        row, place = np.concatenate(row), np.concatenate(place)
        first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=bins.shape[1]))])
        return _Uncommon(features, common, first, place[np.argsort(row, kind="stable")])

    def sums(self, bins: np.ndarray, rows: np.ndarray, at: np.ndarray, nodes: int, parts: tuple[np.ndarray, ...],
             columns: np.ndarray, uncommon: _Uncommon | None = None) -> np.ndarray:
        """(part, node, bin): whole-number sums of `parts`, and the number of rows, over `rows` in node `at`; of all but `columns` 0."""
        out = np.zeros((len(parts) + 1, nodes, int(self.first[-1])), np.int64)
        widths = np.diff(self.first)[columns]
        for f in columns[widths > NARROW_BINS]:
            a, b = self.first[f], self.first[f + 1]
            cell = bins[f].take(rows).astype(np.int64)
            if nodes > 1:
                cell += at * (b - a)
            for total, part in zip(out, (*parts, None)):
                total[:, a:b] = np.bincount(cell, weights=part, minlength=nodes * (b - a)).reshape(nodes, b - a)
        narrow = columns[widths <= NARROW_BINS]
        if not len(narrow):
            return out
        drawn = np.ones(len(narrow), bool)
        if uncommon is not None:
            drawn = np.isin(uncommon.features, narrow)
            narrow, common, (place, row) = uncommon.features, uncommon.common, uncommon.of(rows)
        else:
            # One feature at a time: a node of few rows must not cost a copy of the whole block.
            common, place, row = np.zeros(len(narrow), np.int64), [], []
            for k, f in enumerate(narrow):
                own = bins[f].take(rows)
                common[k] = np.argmax(np.bincount(own, minlength=NARROW_BINS))
                row.append(np.flatnonzero(own != common[k]))
                place.append(own.take(row[-1]).astype(np.int64) + k * NARROW_BINS)
            place, row = np.concatenate(place), np.concatenate(row)
        cells = len(narrow) * NARROW_BINS
        if nodes > 1:
            place += at[row] * cells
        for total, part in zip(out, (*parts, None)):
            whole = np.bincount(at, weights=part, minlength=nodes).astype(np.int64)
            found = np.bincount(place, weights=None if part is None else part[row], minlength=nodes * cells).astype(np.int64)
            found = found.reshape(nodes, len(narrow), NARROW_BINS)
            found[:, np.arange(len(narrow)), common] = whole[:, None] - found.sum(axis=2)
            for k in np.flatnonzero(drawn):
                a, b = self.first[narrow[k]], self.first[narrow[k] + 1]
                total[:, a:b] = found[:, k, :b - a]
        return out

    def coded(self, layout: _Layout, bins: np.ndarray, rows: np.ndarray, at: np.ndarray, nodes: int, parts: tuple[np.ndarray, ...],
              columns: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """As `sums`, by the values of bytes that hold one of `columns`; added to `out` if it is given."""
        if out is None:
            out = np.zeros((len(parts) + 1, nodes, int(layout.first[-1])), np.int64)
        for c in np.unique(layout.column[columns]):
            a, b = layout.first[c], layout.first[c + 1]
            cell = bins[c].take(rows).astype(np.int64)
            if nodes > 1:
                cell += at * (b - a)
            for total, part in zip(out, (*parts, None)):
                found = np.bincount(cell, weights=part, minlength=nodes * (b - a))
                total[:, a:b] += found.reshape(nodes, b - a).astype(np.int64)
        return out

    def spread(self, layout: _Layout, coded: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sums by bin from those by the values of bytes: a common bin has what the others leave."""
        out = np.zeros((*coded.shape[:2], int(self.first[-1])), np.int64)
        whole: dict[int, np.ndarray] = {}
        for f in columns:
            a, b, c, base = self.first[f], self.first[f + 1], layout.column[f], layout.base[f]
            start = layout.first[c]
            if base < 0:
                out[:, :, a:b] = coded[:, :, start:start + b - a]
                continue
            if c not in whole:
                whole[c] = coded[:, :, start:layout.first[c + 1]].sum(axis=2)
            own = out[:, :, a:b]
            own[:] = coded[:, :, start + base:start + base + b - a]
            own[:, :, layout.common[f]] = whole[c] - own.sum(axis=2)
        return out

    def total(self, grid: np.ndarray, columns: np.ndarray) -> np.ndarray:
        f = columns[0]
        return grid[:, self.first[f]:self.first[f + 1]].sum(axis=1)

    def best_split(self, grid: np.ndarray, columns: np.ndarray) -> tuple[float, int, int, bool, np.ndarray]:
        """(gain, feature, bin, missing left, sums of the left side); feature -1 if no split gains.

        Of equal gains the first in order of feature and bin, with missing values on the right.
        """
        l2, least, size = self.settings.l2, self.settings.least_cover, int(self.first[-1])
        feature = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        # Values may be split after each of their bins but the last; the first bin is that of missing ones.
        able = np.zeros(len(self.first) - 1, bool)
        able[columns] = True
        able = able[feature]
        able[self.first[:-1]] = able[self.first[1:] - 1] = False
        upto, missing = np.cumsum(grid, axis=1), grid[:, self.first[:-1]]
        before = upto[:, self.first[:-1]]
        total = self.total(grid, columns)
        found = []
        for missing_left in (False, True) if missing[-1].any() else (False,):
            left = upto - (before - missing if missing_left else before)[:, feature]
            use = able & (missing[-1][feature] > 0) if missing_left else able
            (gl, hl), (g, h) = left[:2] / self.unit, total[:2] / self.unit
            value = lambda a, b: a * a / (b + l2)
            gain = value(gl, hl) + value(g - gl, h - hl) - value(g, h)
            gain[~use | (hl < least) | (h - hl < least)] = -np.inf
            k = int(np.argmax(gain)) if size else 0
            found.append((float(gain[k]), -int(feature[k]), not missing_left, k - int(self.first[feature[k]]), left[:, k]))
        gain, f, missing_right, k, left = max(found, key=lambda r: r[:3])
        if not gain > LEAST_GAIN:
            return LEAST_GAIN, -1, 0, False, np.zeros(3, np.int64)
        return gain, -f, k, not missing_right, left

    def leaf(self, sums: np.ndarray) -> tuple[float, float]:
        """Value and cover of a node with these sums."""
        g, h = sums[0] / self.unit, sums[1] / self.unit
        return -self.settings.step * g / (h + self.settings.l2), h

    def grow_below(self, tree: Tree, node: int, grid: np.ndarray, columns: np.ndarray, rows: np.ndarray, held: _Held,
                   parts: tuple[np.ndarray, ...]) -> None:
        """Grow all below `node` from its rows, which are at hand."""
        total = self.total(grid, columns)
        tree.value[node], tree.cover[node] = self.leaf(total)
        if node >= 2**self.settings.depth - 1:
            return
        gain, feature, cut, missing_left, left = self.best_split(grid, columns)
        if feature < 0:
            return
        tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = feature, cut, missing_left, gain
        seen = held.seen(feature, rows)
        low = np.where(seen == 0, missing_left, seen <= cut)
        sides = {2 * node + 1: rows[low], 2 * node + 2: rows[~low]}
        if 2 * node + 1 >= 2**self.settings.depth - 1:
            for child, sums in ((2 * node + 1, left), (2 * node + 2, total - left)):
                tree.value[child], tree.cover[child] = self.leaf(sums)
            return
        light = min(sides, key=lambda c: len(sides[c]))
        own = sides[light]
        found = held.sums(own, parts, columns)
        for child, of in sides.items():
            self.grow_below(tree, child, found if child == light else grid - found, columns, of, held, parts)


class _Held:
    """Rows at hand, counted many times."""

    def __init__(self, grid: _Grid, pieces: list[tuple[int, np.ndarray]], layouts: tuple[_Layout, _Layout]):
        self.grid, (self.bins, kind) = grid, _together(pieces, layouts)
        self.kind, self.layout = kind, layouts[kind]
        self.uncommon = grid.uncommon(self.bins) if kind == _PLAIN else None

    def seen(self, feature: int, rows: np.ndarray) -> np.ndarray:
        return self.layout.bins[feature].take(self.bins[self.layout.column[feature]].take(rows))

    def sums(self, rows: np.ndarray, parts: tuple[np.ndarray, ...], columns: np.ndarray) -> np.ndarray:
        """(part, bin) over `rows`; `parts` are those of all rows."""
        at, own = np.zeros(len(rows), np.int64), tuple(p.take(rows) for p in parts)
        if self.uncommon is not None:
            return self.grid.sums(self.bins, rows, at, 1, own, columns, self.uncommon)[:, 0]
        return self.grid.spread(self.layout, self.grid.coded(self.layout, self.bins, rows, at, 1, own, columns), columns)[:, 0]


_TREE = ("feature", "bin", "missing_left", "value", "gain", "cover")


class _Grower:
    """What a fit knows on the driver, and its jobs."""

    def __init__(self, blocks: DataFrame, cuts: list[np.ndarray], bundled: _Layout | None, settings: Settings, weight: float, total: float,
                 rows: int, judges: bool, path: str):
        plain = _Layout.plain(_widths(cuts))
        self.layouts = (bundled or plain, plain)
        self.blocks, self.cuts, self.settings, self.weight, self.rows, self.path = blocks, cuts, settings, weight, rows, path
        # Whether there are rows of validation.
        self.judges = judges
        # Sums of a block must fit 53 bits, sums of all rows 62.
        block_bits = 53 - _BLOCK_BITS - np.ceil(np.log2(max(weight, 1)))
        unit = 2.0 ** min(24, block_bits, np.floor(62 - np.log2(max(total, 1))))
        # What one task gathers must fit 53 bits as well.
        unit = min(unit, 2.0 ** np.floor(53 - np.log2(max(settings.gather_rows * weight, 1))))
        self.grid = _Grid(np.concatenate([[0], np.cumsum([len(c) + 2 for c in cuts])]), unit, settings)
        self.held: RDD | None = None
        # Trees whose values are not in the stored margins yet.
        self.trees: list[Tree] = []
        # Those whose values are not in the written ones, the links from the written blocks to the held, and the blocks held before.
        self.unwritten: list[Tree] = []
        self.links, self.before = 0, None
        # Of earlier trees, the last one first: node -> (feature, bin, missing left) of nodes that were counted.
        self.tops: list[dict[int, tuple[int, int, bool]]] = []
        # Trees grown ahead of their rounds, with log loss and rows of validation before each.
        self.ahead: dict[int, tuple[Tree, np.ndarray]] = {}
        self.stored = ""

    def _rows(self, number: int, level: int, tree: Tree, nodes: list[int], loss: bool):
        """For a task: each block, its drawn rows in `nodes`, their places there and their parts, and the loss."""
        settings, unit, weight, trees, layouts = self.settings, self.grid.unit, self.weight, self.trees, self.layouts

        def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
            slot = np.full(2 ** (settings.depth + 1), -1)
            slot[nodes] = np.arange(len(nodes))
            walks, own = _Walks(trees, layouts), _Walks([tree], layouts)
            for block in _blocks(blocks):
                lost = np.zeros(2, np.int64)
                if loss:
                    judged = np.flatnonzero(block.role == _VALIDATION)
                    lost += _loss(block.label[judged], _with_trees(block, walks, settings.depth, judged), unit)
                use = at = np.zeros(0, np.int64)
                if not loss and not (block.role == _TRAIN).any():
                    continue
                if nodes:
                    use = np.flatnonzero((block.role == _TRAIN) & _drawn(block.draw, settings.seed, number, settings.row_share))
                    at = slot.take(_leaf_of(own.of(block.layout)[0], block.bins, level, use))
                    inside = np.flatnonzero(at >= 0)
                    if len(inside) < len(use):
                        use, at = use.take(inside), at.take(inside)
                p, label = 1 / (1 + np.exp(-_with_trees(block, walks, settings.depth, use))), block.label.take(use)
                w = np.where(label == 1, weight, 1.0)
                g, h = np.rint((p - label) * w * unit), np.rint(p * (1 - p) * w * unit)
                yield block, use, at, g, h, lost

        return run

    def sums(self, tree: Tree, number: int, level: int, nodes: list[int], columns: np.ndarray, loss: bool) -> dict[int, np.ndarray]:
        """For each of `nodes`, (gradient, hessian, rows) by bin of all features; under -1 log loss and rows of validation."""
        rows_of, grid, layouts, n_bins = self._rows(number, level, tree, nodes, loss), self.grid, self.layouts, int(self.grid.first[-1])

        def run(blocks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
            added, lost, coded = np.zeros((3, len(nodes), n_bins), np.int64), np.zeros(2, np.int64), None
            for block, use, at, g, h, own in rows_of(blocks):
                lost += own
                if len(use) and block.layout == _BUNDLED:
                    coded = grid.coded(layouts[_BUNDLED], block.bins, use, at, len(nodes), (g, h), columns, coded)
                elif len(use):
                    added += grid.sums(block.bins, use, at, len(nodes), (g, h), columns)
            if coded is not None:
                added += grid.spread(layouts[_BUNDLED], coded, columns)
            for k, node in enumerate(nodes):
                if added[:, k].any():
                    yield node, added[:, k]
            if loss:
                yield -1, lost

        found = self.held.mapPartitions(run)
        if found.getNumPartitions() * len(nodes) > _UNADDED:
            found = found.reduceByKey(np.add, min(len(nodes) + 1, self.held.context.defaultParallelism))
        out = {node: np.zeros((3, n_bins), np.int64) for node in nodes}
        if loss:
            out[-1] = np.zeros(2, np.int64)
        for node, own in found.collect():
            out[node] += own
        return out

    def gather(self, tree: Tree, number: int, level: int, nodes: list[int], columns: np.ndarray) -> None:
        """Grow `tree` below `nodes`, each in one task that gets its rows."""
        rows_of, grid, layouts, depth = self._rows(number, level, tree, nodes, False), self.grid, self.layouts, self.settings.depth

        def send(blocks: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
            found: dict[tuple[int, int], list] = {}
            for block, use, at, g, h, _ in rows_of(blocks):
                order = np.argsort(at.astype(np.int16), kind="stable")
                ends = np.cumsum(np.bincount(at, minlength=len(nodes)))
                for k in np.unique(at).tolist():
                    mine = order[ends[k - 1] if k else 0:ends[k]]
                    found.setdefault((k, block.layout), []).append((block.bins.take(use.take(mine), axis=1), g.take(mine), h.take(mine)))
            for k, layout in list(found):
                rows = found.pop((k, layout))
                yield k, (layout, *(np.concatenate([r[i] for r in rows], axis=-1) for i in range(3)))

        def finish(sent: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple]]:
            held: dict[int, list] = {}
            for k, rows in sent:
                held.setdefault(k, []).append(rows)
            for k in list(held):
                rows = held.pop(k)
                g, h = (np.concatenate([r[i] for r in rows]) for i in (2, 3))
                own = _Held(grid, [r[:2] for r in rows], layouts)
                del rows
                every, grown = np.arange(len(g)), Tree.empty(depth)
                grid.grow_below(grown, nodes[k], own.sums(every, (g, h), columns), columns, every, own, (g, h))
                place = np.flatnonzero(grown.cover)
                yield nodes[k], (place, *(getattr(grown, c)[place] for c in _TREE))

        tasks = min(len(nodes), 4 * self.held.context.defaultParallelism)
        for node, own in self.held.mapPartitions(send).partitionBy(tasks, int).mapPartitions(finish).collect():
            for c, values in zip(_TREE, own[1:]):
                getattr(tree, c)[own[0]] = values

    def grow(self, number: int, more: bool, columns: np.ndarray, loss: bool) -> tuple[Tree | None, np.ndarray]:
        """The next tree, if `more`, and log loss and rows of validation with the trees before it."""
        grid, tree, few = self.grid, Tree.empty(self.settings.depth), self.settings.gather_rows
        if not more:
            return None, self.sums(tree, number, 0, [], columns, loss)[-1]
        if self.rows <= few:
            if number not in self.ahead:
                self.ahead = self._grown_ahead(number)
            return self.ahead.pop(number)
        guess, top = self._guess(columns), {}
        found = self._counted_ahead(number, guess, columns, loss)
        lost, grids, gathered = found.get(-1, np.zeros(2, np.int64)), {0: found[0]}, []
        tree.value[0], tree.cover[0] = grid.leaf(grid.total(found[0], columns))
        for level in range(self.settings.depth):
            light = {}
            for node, own in sorted(grids.items()):
                gain, feature, cut, missing_left, left = grid.best_split(own, columns)
                if feature < 0:
                    continue
                tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = feature, cut, missing_left, gain
                top[node] = (feature, cut, missing_left)
                sides = {2 * node + 1: left, 2 * node + 2: grid.total(own, columns) - left}
                for child, sums in sides.items():
                    tree.value[child], tree.cover[child] = grid.leaf(sums)
                small = [c for c, sums in sides.items() if sums[2] <= few]
                if level + 1 < self.settings.depth:
                    gathered += small
                    if len(small) < 2:
                        light[node] = min(sides, key=lambda c: sides[c][2])
            if not light:
                break
            # What was counted ahead holds if this node and those above it split as guessed.
            guess = {node: split for node, split in guess.items() if node not in top or top[node] == split}
            guess = {node: split for node, split in guess.items() if not node or (node - 1) // 2 in guess}
            ahead = {node for node in light if node in guess}
            rest = [child for node, child in light.items() if node not in ahead]
            counted = self.sums(tree, number, level + 1, rest, columns, False) if rest else {}
            wide = set()
            for node, child in light.items():
                wide |= {2 * node + 1, 2 * node + 2} - set(gathered)
                if node in ahead:
                    counted |= {c: found[c] for c in (2 * node + 1, 2 * node + 2)}
                else:
                    counted[4 * node + 3 - child] = grids[node] - counted[child]
            grids = {c: counted[c] for c in wide}
        if gathered:
            self.gather(tree, number, self.settings.depth, gathered, columns)
        self.tops = [top, *self.tops][:_LOOK_BACK]
        return tree, lost

    def _grown_ahead(self, number: int) -> dict[int, tuple[Tree, np.ndarray]]:
        """The trees from `number` up to the next store of margins, grown in one task that gets the rows of training; each with
        log loss and rows of validation before it, which every task adds up for its own rows."""
        settings, grid, weight, trees, layouts, width = self.settings, self.grid, self.weight, self.trees, self.layouts, len(self.cuts)
        numbers = range(number, min(settings.rounds, number + max(settings.keep_every - len(trees), 1)))

        def send(blocks: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
            walks = _Walks(trees, layouts)
            for block in _blocks(blocks):
                own = np.flatnonzero(block.role == _TRAIN)
                margin = _with_trees(block, walks, settings.depth, own)
                yield 0, (block.layout, block.bins.take(own, axis=1), block.label[own], block.draw[own], margin)

        def finish(sent: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, Tree]]:
            held = [rows for _, rows in sent]
            if not held:
                return
            own = _Held(grid, [r[:2] for r in held], layouts)
            label, draw, margin = (np.concatenate([r[i] for r in held]) for i in (2, 3, 4))
            del held
            every, w = np.arange(len(label)), np.where(label == 1, weight, 1.0)
            for k in numbers:
                grown, columns = Tree.empty(settings.depth), _columns(width, settings.seed, k, settings.column_share)
                use = np.flatnonzero(_drawn(draw, settings.seed, k, settings.row_share))
                if len(use):
                    p = 1 / (1 + np.exp(-margin))
                    parts = np.rint((p - label) * w * grid.unit), np.rint(p * (1 - p) * w * grid.unit)
                    grid.grow_below(grown, 0, own.sums(use, parts, columns), columns, use, own, parts)
                    margin += grown.value[_leaf_of(grown.steps(own.layout), own.bins, settings.depth, every)]
                yield k, grown

        grown = dict(self.held.mapPartitions(send).partitionBy(1, int).mapPartitions(finish).collect())

        def judge(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
            walks, ahead = _Walks(trees, layouts), _Walks([grown[k] for k in numbers], layouts)
            lost = np.zeros((len(numbers), 2), np.int64)
            for block in _blocks(blocks):
                judged, steps = np.flatnonzero(block.role == _VALIDATION), ahead.of(block.layout)
                margin = _with_trees(block, walks, settings.depth, judged)
                for i, k in enumerate(numbers):
                    lost[i] += _loss(block.label[judged], margin, grid.unit)
                    margin += grown[k].value[_leaf_of(steps[i], block.bins, settings.depth, judged)]
            yield lost

        lost = np.zeros((len(numbers), 2), np.int64)
        for own in self.held.mapPartitions(judge).collect() if self.judges else []:
            lost += own
        return {k: (grown[k], lost[i]) for i, k in enumerate(numbers)}

    def _guess(self, columns: np.ndarray) -> dict[int, tuple[int, int, bool]]:
        """How the uppermost nodes may split: as in the last tree that split there on one of `columns`, below the same root."""
        drawn, guess = set(columns.tolist()), {}
        for top in self.tops:
            for node, split in sorted(top.items()):
                above = not node or ((node - 1) // 2 in guess and top.get(0) == guess[0])
                if node < 2**_GUESSED - 1 and node not in guess and above and split[0] in drawn:
                    guess[node] = split
        return guess

    def _counted_ahead(self, number: int, guess: dict[int, tuple[int, int, bool]], columns: np.ndarray, loss: bool) -> dict[int, np.ndarray]:
        """The sums of the root, and of all nodes that there are if the nodes of `guess` split so: each row is counted once, at a leaf."""
        tree = Tree.empty(self.settings.depth)
        for node, (feature, cut, missing_left) in guess.items():
            tree.feature[node], tree.bin[node], tree.missing_left[node] = feature, cut, missing_left
        leaves = sorted({c for node in guess for c in (2 * node + 1, 2 * node + 2)} - set(guess)) or [0]
        found = self.sums(tree, number, _GUESSED, leaves, columns, loss)
        for node in sorted(guess, reverse=True):
            found[node] = found[2 * node + 1] + found[2 * node + 2]
        return found

    def store(self, number: int) -> None:
        """Bring the margins of the blocks up to all trees so far: in the held ones, and after some times in written ones."""
        self.unwritten += self.trees
        if self.held is not None and self.links < _LINKS:
            if self.trees:
                self._hold_on()
            self.links += 1
        else:
            self._write(number)
        self.trees = []

    def refresh(self) -> None:
        """Bring the margins of the held blocks up to all trees so far, between two stores."""
        self.unwritten += self.trees
        self._hold_on()
        self.trees = []

    def _hold_on(self) -> None:
        """Hold the blocks with new margins. The next job makes them; a lost one is made again from the written blocks."""
        trees, depth, layouts = self.trees, self.settings.depth, self.layouts

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            walks = _Walks(trees, layouts)
            for row in rows:
                (block,) = _blocks([row])
                yield *row[:-1], _with_trees(block, walks, depth, np.arange(len(block.label))).tobytes()

        self._let_go()
        self.before, self.held = self.held, self.held.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)

    def _let_go(self) -> None:
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def _write(self, number: int) -> None:
        """Write the blocks with the margins of all trees so far; the earlier ones go."""
        trees, depth, layouts = self.unwritten, self.settings.depth, self.layouts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walks = _Walks(trees, layouts)
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in batch.schema.names))
                margins = [_with_trees(b, walks, depth, np.arange(len(b.label))).tobytes() for b in _blocks(rows)]
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))

        blocks = self.blocks.mapInArrow(run, _BLOCK) if trees else self.blocks
        spark, before = blocks.sparkSession, self.stored
        self.stored = f"{self.path}/blocks-{number}-{uuid4().hex}"
        blocks.write.parquet(self.stored)
        self.close(before)
        self.blocks = spark.read.schema(blocks.schema).parquet(self.stored)
        # As many tasks as cores, or a multiple of them, with as many blocks each: none of a pass waits for a larger one.
        cores, row_bytes = spark.sparkContext.defaultParallelism, len(self.layouts[_BUNDLED].first) + 17
        waves = 1 + self.rows * row_bytes // (cores * _TASK_BYTES)
        kept = self.blocks
        if kept.rdd.getNumPartitions() != waves * cores:
            kept = kept.repartition(waves * cores)
        self.held = kept.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        self.unwritten, self.links = [], 0

    def close(self, stored: str) -> None:
        self._let_go()
        if self.held is not None:
            self.held.unpersist()
        if stored:
            delete_folder(self.blocks.sparkSession, stored)


@dataclass(frozen=True)
class BoostedTrees:
    """A model as a table of nodes, whose size depends on the settings only."""

    features: list[str]
    nodes: pa.Table

    @property
    def rounds(self) -> int:
        trees = self.nodes.column("tree").to_numpy()
        return int(trees.max()) + 1 if len(trees) else 0

    @classmethod
    def of(cls, features: list[str], trees: list[Tree], cuts: list[np.ndarray]) -> BoostedTrees:
        rows = []
        for t, tree in enumerate(trees):
            reached = [0]
            for node in reached:
                f = int(tree.feature[node])
                if f < 0:
                    rows.append((t, node, None, None, None, None, None, tree.value[node], None, tree.cover[node]))
                    continue
                left, right = 2 * node + 1, 2 * node + 2
                rows.append((t, node, features[f], cuts[f][tree.bin[node] - 1], bool(tree.missing_left[node]), left, right,
                             tree.value[node], tree.gain[node], tree.cover[node]))
                reached += [left, right]
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return cls(list(features), pa.table({
            n: pa.array([None if v is None else v.item() if isinstance(v, np.generic) else v for v in c], kinds[d.split()[1]])
            for n, c, d in zip(names, columns, NODE_SCHEMA.split(", "))}))

    def table(self, spark: SparkSession) -> DataFrame:
        """The nodes; `value` of an inner node is what it would give as a leaf."""
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        local_table(spark, list(enumerate(self.features)), "place int, feature string").write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        named = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").orderBy("tree", "node").toArrow()
        return cls([r["feature"] for r in named], nodes)

    def _arrays(self, used: list[str]) -> dict:
        """All trees in flat arrays; a leaf is its own child."""
        n = self.nodes.to_pydict()
        width = max(n["node"], default=0) + 1
        size = max(self.rounds, 1) * width
        feature, cut, value = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        children, missing = np.repeat(np.arange(size), 2), np.zeros(size, bool)
        place = {name: k for k, name in enumerate(used)}
        for t, node, name, c, m, left, right, v in zip(*(n[c] for c in (
                "tree", "node", "feature", "cut", "missing_left", "left", "right", "value"))):
            at = t * width + node
            if name is None:
                value[at] = v
            else:
                feature[at], cut[at], missing[at] = place[name], c, m
                children[2 * at], children[2 * at + 1] = t * width + right, t * width + left
        levels = int(np.floor(np.log2(width))) if width > 1 else 0
        return {"roots": np.arange(self.rounds) * width, "feature": feature, "cut": cut, "value": value,
                "children": children, "missing": missing, "levels": levels}

    def margin(self, df: DataFrame, rows_at_once: int = 512) -> Column:
        """The sum of the leaf values, log odds of fraud, as a column of `df`."""
        used = sorted({f for f in self.nodes.column("feature").to_pylist() if f is not None}) or self.features[:1]
        trees, width = df.sparkSession.sparkContext.broadcast(self._arrays(used)), len(used)

        @F.arrow_udf("double")
        def walk(column: pa.Array) -> pa.Array:
            a, x = trees.value, _matrix(column, width).ravel()
            n = len(x) // width
            total = np.zeros(n)
            for start in range(0, n, rows_at_once):
                stop = min(start + rows_at_once, n)
                block = x[start * width:stop * width]
                first = (np.arange(stop - start) * width)[:, None]
                node = np.broadcast_to(a["roots"], (stop - start, len(a["roots"])))
                for _ in range(a["levels"]):
                    seen = block.take(a["feature"].take(node) + first)
                    left = (seen <= a["cut"].take(node)) | (np.isnan(seen) & a["missing"].take(node))
                    node = a["children"].take(2 * node + left)
                total[start:stop] = a["value"].take(node).sum(axis=1)
            return pa.array(total)

        return walk(_vector(used))

    def score(self, df: DataFrame, output: str = "fraud_probability") -> DataFrame:
        """`df` with the probability of fraud."""
        return df.withColumn(output, 1 / (1 + F.exp(-self.margin(df))))

    def importances(self, spark: SparkSession, kind: str = "gain") -> DataFrame:
        """(feature, importance), shares of 1: mean gain of a feature's splits, `total_gain`, or number of splits (`weight`)."""
        value = {"gain": F.avg("gain"), "total_gain": F.sum("gain"), "weight": F.count("gain").cast("double")}[kind]
        named = local_table(spark, [(f,) for f in self.features], "feature string")
        found = self.table(spark).where("feature is not null").groupBy("feature").agg(value.alias("worth"))
        rows = named.join(F.broadcast(found), "feature", "left").select("feature", F.coalesce("worth", F.lit(0.0)).alias("worth"))
        total = rows.agg(F.sum("worth")).first()[0] or 1.0
        return rows.select("feature", (F.col("worth") / total).alias("importance"))


@dataclass(frozen=True)
class Fitted:
    model: BoostedTrees
    rounds: int
    losses: list[float]


def best_round(losses: list[float], patience: int) -> int:
    """Rounds to keep: the best one before `patience` rounds in a row bring no gain."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def _is_over(losses: list[float], patience: int) -> bool:
    return bool(losses) and len(losses) - int(np.argmin(losses)) > patience


_STATE = "number int, feature binary, bin binary, missing_left binary, value binary, gain binary, cover binary, loss double"


def _save_state(spark: SparkSession, folder: str, mark: str, trees: list[Tree], losses: list[float]) -> None:
    rows = [(k, *(getattr(t, c).tobytes() for c in _TREE),
             losses[k] if k < len(losses) else None) for k, t in enumerate(trees)]
    path = f"{folder}/{mark}-{len(trees):06d}"
    local_table(spark, rows, _STATE).write.mode("overwrite").parquet(path)


def _load_state(spark: SparkSession, folder: str, mark: str) -> tuple[list[Tree], list[float]]:
    """The longest complete state under `folder` of the same settings and cuts."""
    whole = sorted(p for p in folders_in(spark, folder, "_SUCCESS") if p.rsplit("/", 1)[-1].startswith(f"{mark}-"))
    if not whole:
        return [], []
    kinds = {"feature": np.int64, "bin": np.int64, "missing_left": bool, "value": float, "gain": float, "cover": float}
    rows = spark.read.schema(_STATE).parquet(whole[-1]).orderBy("number").collect()
    trees = [Tree(*(np.frombuffer(r[c], k).copy() for c, k in kinds.items())) for r in rows]
    return trees, [r["loss"] for r in rows if r["loss"] is not None]


def fit(train: DataFrame, validation: DataFrame | None, features: list[str], key: str = S.ROW_KEY,
        settings: Settings = Settings(), folder: str | None = None, cuts: list[np.ndarray] | None = None) -> Fitted:
    """Boosted trees on the label; rows of the rarer class weigh as much together as the others.

    With `folder`, the trees so far are stored there every `keep_every` rounds, and a fit with the same rows and
    settings goes on from the last stored round. `cuts` replaces the ones chosen from the rows.
    """
    spark = train.sparkSession
    negatives, positives = train.agg(F.count_if(F.col(S.LABEL) == 0), F.count_if(F.col(S.LABEL) == 1)).first()
    if not positives or not negatives:
        raise ValueError("training needs rows of both classes")
    bundled = None
    if cuts is None:
        seen = _cut_rows(train, features, key, settings)
        cuts = _cuts_of(seen, settings)
        bundled = _Layout.fit(_bins(seen, cuts), _widths(cuts))
    wanted = [key, S.LABEL, *(c for c in features if c not in (key, S.LABEL))]
    rows = train.select(*wanted, F.lit(_TRAIN).alias("_role"))
    if validation is not None:
        rows = rows.unionByName(validation.select(*wanted, F.lit(_VALIDATION).alias("_role")))
    grower = _Grower(binned(rows, features, key, cuts, bundled), cuts, bundled, settings, negatives / positives, 2.0 * negatives, negatives + positives,
                     validation is not None, f"{run_folder(spark)}/boosting-{uuid4().hex}")
    mark = f"state-{_fingerprint(features, cuts, settings, negatives, positives):016x}"
    trees, losses = _load_state(spark, folder, mark) if folder else ([], [])
    try:
        grower.store(0)
        if trees:
            grower.trees = list(trees)
            grower.store(len(trees))
        kept = len(trees)
        while True:
            number, judged = len(trees), validation is not None and len(losses) < len(trees)
            more = number < settings.rounds and not _is_over(losses, settings.patience)
            if not more and not judged:
                break
            columns = _columns(len(features), settings.seed, number, settings.column_share)
            tree, (lost, n) = grower.grow(number, more, columns, judged)
            grower._let_go()
            if judged:
                losses.append(float(lost / grower.grid.unit / max(n, 1)))
                if _is_over(losses, settings.patience):
                    break
            if tree is None:
                break
            trees.append(tree)
            grower.trees.append(tree)
            if len(trees) - kept >= settings.keep_every:
                grower.store(len(trees))
                kept = len(trees)
                if folder:
                    _save_state(spark, folder, mark, trees, losses)
            elif grower.rows > settings.gather_rows and len(grower.trees) >= _FRESH:
                grower.refresh()
    finally:
        grower.close(grower.stored)
    rounds = best_round(losses, settings.patience) if losses else len(trees)
    return Fitted(BoostedTrees.of(features, trees[:rounds], cuts), rounds, losses)


def _fingerprint(features: list[str], cuts: list[np.ndarray], settings: Settings, *counts: int) -> int:
    """A number for what a stored state depends on; more rounds may be asked for later."""
    import hashlib

    told = repr((features, [c.tolist() for c in cuts], asdict(replace(settings, rounds=0)), counts))
    return int.from_bytes(hashlib.sha256(told.encode()).digest()[:8], "big")
