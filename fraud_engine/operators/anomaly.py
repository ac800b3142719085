"""Unsupervised detectors: isolation forest and reconstruction error."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import schema as S
from ..session import local_table, materialize
from .ranking import exact_percentiles

EULER_GAMMA = 0.5772156649015329
# A node's children are 2 node + 1 and 2 node + 2; a leaf has feature -1 and is its own child. `impurity` is the
# variance of a random target of the rows, as in regression trees grown at random.
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, n int, depth int, impurity double"
)
# Rows that walk all trees together, so that the working arrays stay in the processor's cache.
BLOCK_ROWS = 512
# Rows whose waves a task holds at once.
_WAVE_ROWS = 4096


def _unit_hash(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from the parts."""
    return F.xxhash64(*parts).cast("double") / F.lit(2.0**64) + 0.5


def mean_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + EULER_GAMMA) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _draw(*parts) -> float:
    """A repeatable number in [0, 1) from the parts."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2.0**52


def _grow(tree: int, x: np.ndarray, order: np.ndarray, seed: int, max_depth: int) -> pd.DataFrame:
    """Nodes of one isolation tree over the rows `x`, which `order` tells apart.

    A node splits one of the features that differ in it, at a random place between least and greatest value; both
    draws depend on seed, tree and node alone.
    """
    target = np.array([_draw(seed, tree, "y", o) for o in order.tolist()])
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, 0)]
    while stack:
        rows, depth, node = stack.pop()
        feature, threshold, left, right = -1, 0.0, node, node
        if depth < max_depth and len(rows) > 1:
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            splittable = np.flatnonzero(hi > lo)
            if len(splittable):
                feature = int(splittable[int(_draw(seed, tree, node, 0) * len(splittable))])
                threshold = float(lo[feature] + _draw(seed, tree, node, 1) * (hi[feature] - lo[feature]))
                if threshold >= hi[feature]:  # rounded up; the right side must hold a row
                    threshold = float(lo[feature])
                left, right = 2 * node + 1, 2 * node + 2
        nodes.append([tree, node, feature, threshold, left, right, len(rows), depth, float(target[rows].var()) if len(rows) else 0.0])
        if feature >= 0:
            low = x[rows, feature] <= threshold
            stack.append((rows[~low], depth + 1, right))
            stack.append((rows[low], depth + 1, left))
    return pd.DataFrame(nodes, columns=[f.split()[0] for f in NODE_SCHEMA.split(", ")])


def sample_per_tree(df: DataFrame, features: str, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, order, features): a few more than `sample` rows for every tree.

    Every tree takes every row with the same chance, independently of the other trees and by a hash of
    the row key alone, so neither partitions nor retries change it. The first tree of a row comes from
    one draw of the geometric distribution; most rows of a large table have none and go no further.
    """
    rows = df.count()
    share = min(1.0, (sample + 6 * math.sqrt(sample)) / max(rows, 1))
    first = F.lit(0)
    if share < 1.0:
        unit = F.greatest(_unit_hash(F.lit(seed), F.col("key")), F.lit(0.0))
        first = F.floor(F.log1p(-unit) / F.lit(math.log1p(-share))).cast("int")
    taken = df.select(F.col(key).alias("key"), F.col(features).alias("features")).withColumn(
        "_first", first).where(F.col("_first") < trees)
    later = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: (t == F.col("_first"))
        | ((t > F.col("_first")) & (_unit_hash(F.lit(seed + 1), t, F.col("key")) < share)),
    )
    return taken.select(F.explode(later).alias("tree"), "key", "features").select(
        "tree", F.xxhash64(F.lit(seed + 2), "tree", "key").alias("order"), "features")


@dataclass(frozen=True)
class IsolationForest:
    """A forest as a table of nodes, whose size depends on the parameters only."""

    nodes: DataFrame
    trees: int
    sample: int

    @classmethod
    def fit(cls, df: DataFrame, features: str = "features", key: str = S.ROW_KEY,
            trees: int = 200, sample: int = 256, seed: int = 42) -> "IsolationForest":
        """`features` is an array<double> column without nulls, `key` a unique row key."""
        return cls.grow(sample_per_tree(df, features, key, trees, sample, seed), trees, sample, seed)

    @classmethod
    def grow(cls, samples: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42) -> "IsolationForest":
        """From (tree, order, features): every tree grows on its `sample` rows of lowest order."""
        max_depth = math.ceil(math.log2(max(sample, 2)))

        def one(group: pd.DataFrame) -> pd.DataFrame:
            chosen = group.nsmallest(sample, "order")
            return _grow(int(group["tree"].iloc[0]), np.stack(chosen["features"]), chosen["order"].to_numpy(), seed, max_depth)

        grown = samples.groupBy("tree").applyInPandas(one, NODE_SCHEMA)
        return cls(materialize(grown, "isolation_nodes"), trees, sample)

    def _arrays(self) -> dict:
        """All trees in flat arrays with one numbering of nodes; a leaf is its own child."""
        t = self.nodes.toPandas()
        width = int(t["node"].max()) + 1
        place = (t["tree"] * width + t["node"]).to_numpy()
        size = self.trees * width
        feature, threshold, length = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        children = np.zeros(2 * size, np.int64)
        feature[place] = np.maximum(t["feature"], 0)
        threshold[place] = t["threshold"]
        length[place] = t["depth"] + mean_path(t["n"])
        children[2 * place] = t["tree"] * width + t["right"]
        children[2 * place + 1] = t["tree"] * width + t["left"]
        return {
            "roots": np.arange(self.trees) * width, "feature": feature, "threshold": threshold,
            "children": children, "length": length, "levels": int(t["depth"].max()),
            # A tree sees at most all rows, so a small table has a smaller sample.
            "norm": float(mean_path(int(t.loc[t["node"] == 0, "n"].max()))),
        }

    def score(self, df: DataFrame, features: str = "features", output: str = "score") -> DataFrame:
        """`df` with the score in [-1, 0): the lower, the more anomalous."""
        forest = df.sparkSession.sparkContext.broadcast(self._arrays())

        @F.arrow_udf("double")
        def path_score(column: pa.Array) -> pa.Array:
            f = forest.value
            values = column.flatten().to_numpy(zero_copy_only=False)
            rows = len(column)
            width = len(values) // max(rows, 1)
            scores = np.empty(rows)
            for start in range(0, rows, BLOCK_ROWS):
                stop = min(start + BLOCK_ROWS, rows)
                block = values[start * width:stop * width]
                first = (np.arange(stop - start) * width)[:, None]
                node = np.broadcast_to(f["roots"], (stop - start, len(f["roots"])))
                for _ in range(f["levels"]):
                    goes_left = block.take(f["feature"].take(node) + first) <= f["threshold"].take(node)
                    node = f["children"].take(2 * node + goes_left)
                length = f["length"].take(node).mean(axis=1)
                scores[start:stop] = -np.exp2(-length / max(f["norm"], 1e-12))
            return pa.array(scores)

        return df.withColumn(output, path_score(F.col(features)))

    def importances(self, names: list[str], top: int | None = None) -> DataFrame:
        """Decrease of impurity by the splits on a feature, weighted by rows, as a share of the tree's; the mean over all trees."""
        spark, nodes = self.nodes.sparkSession, self.nodes
        named = local_table(spark, list(enumerate(names)), "feature_no int, feature string")
        weighed = nodes.select("tree", "node", (F.col("n") * F.col("impurity")).alias("held"))
        side = lambda c: weighed.select("tree", F.col("node").alias(c), F.col("held").alias(f"{c}_held"))
        splits = nodes.where("feature >= 0").join(side("left"), ["tree", "left"]).join(side("right"), ["tree", "right"])
        gained = splits.select(
            "tree", F.col("feature").alias("feature_no"), (F.col("n") * F.col("impurity") - F.col("left_held") - F.col("right_held")).alias("gain"))
        per_tree = gained.groupBy("tree").agg(F.sum("gain").alias("all"))
        shares = gained.groupBy("tree", "feature_no").agg(F.sum("gain").alias("own")).join(per_tree, "tree").where("all > 0")
        mean = shares.groupBy("feature_no").agg((F.sum(F.col("own") / F.col("all")) / self.trees).alias("share"))
        table = named.join(F.broadcast(mean), "feature_no", "left").select(
            "feature", F.coalesce("share", F.lit(0.0)).alias("importance"),
        ).orderBy(F.desc("importance"), "feature")
        return table if top is None else table.limit(top)

    def save(self, path: str) -> None:
        self.nodes.withColumns({"trees": F.lit(self.trees), "sample": F.lit(self.sample)}) \
            .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForest":
        stored = spark.read.parquet(path)
        head = stored.select("trees", "sample").first()
        return cls(stored.drop("trees", "sample"), head["trees"], head["sample"])


def _cut(scored: DataFrame, score: str, probability: float) -> Column:
    """The percentile as a constant; null for a table without scores."""
    found = exact_percentiles(scored, score, [probability]).first()
    return F.lit(found["value"] if found else None).cast("double")


def flag_lowest(scored: DataFrame, contamination: float = 0.02, score: str = "score") -> DataFrame:
    """1 for scores below the percentile of `contamination`. Give a stored table: it is re-read."""
    cut = _cut(scored, score, contamination)
    return scored.withColumns({
        "decision": F.col(score) - cut,
        "is_anomaly": (F.col(score) < cut).cast("int"),
    })


def flag_highest(scored: DataFrame, probability: float = 0.99, score: str = "error",
                 exact: bool = True) -> DataFrame:
    """1 for values strictly above the percentile. Give a stored table: it is re-read."""
    if exact:
        cut = _cut(scored, score, probability)
    else:
        cut = scored.agg(F.percentile_approx(score, probability)).first()[0]
    return scored.withColumn("is_anomaly", fn.above_threshold(score, cut))


def _sum_of_squares(array: str, width: int) -> Column:
    """Written out, so that it is compiled; a lambda over the array would be interpreted."""
    return sum((F.col(array)[i] * F.col(array)[i] for i in range(width)), F.lit(0.0))


@dataclass(frozen=True)
class ReconstructionModel:
    """Linear code of width `k` learnt on normal rows."""

    pca: object
    width: int

    @classmethod
    def fit(cls, df: DataFrame, features: str = "features", label: str = S.LABEL, k: int = 16) -> "ReconstructionModel":
        """`features` is a standardised vector column; rows with label 0 are learnt from."""
        normal = df.where(F.col(label) == 0)
        model = PCA(k=k, inputCol=features, outputCol="_code").fit(normal)
        return cls(model, model.pc.numRows)

    def score(self, df: DataFrame, features: str = "features", output: str = "error") -> DataFrame:
        """`df` with the mean squared error of the reconstruction.

        The components are orthonormal, so the error is what the code leaves of the length.
        """
        coded = self.pca.transform(df).withColumns({
            "_row": vector_to_array(features), "_coded": vector_to_array("_code")})
        left = _sum_of_squares("_row", self.width) - _sum_of_squares("_coded", self.pca.getK())
        return coded.withColumn(output, F.greatest(left / self.width, F.lit(0.0))).drop("_code", "_row", "_coded")


def _arrow_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass(frozen=True)
class CurvedReconstruction:
    """Code of width k of random waves, learnt on normal rows: it bends with surfaces that a linear code flattens.

    The waves cos(w z + b), with normal w and even b, have the Gaussian kernel as their mean product (Rahimi and Recht
    2007); what the leading components of the centred waves leave of a row is its novelty by kernel PCA (Hoffmann 2007).
    The matrices depend on width, waves, k and seed alone, whatever the rows. The waves are never stored: each task adds
    up the products of its rows' waves, and Spark adds the tasks' sums.
    """

    weights: np.ndarray
    shift: np.ndarray
    mean: np.ndarray
    components: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, features: str = "features", label: str = S.LABEL, k: int = 16, waves: int = 256,
            width: float | None = None, seed: int = 42) -> "CurvedReconstruction":
        """`features` is a standardised vector column; rows with label 0 are learnt from.

        `width` is the distance at which rows stop being alike, by default that of two independent coordinates each.
        """
        normal = df.where(F.col(label) == 0)
        first = normal.select(vector_to_array(features).alias("v")).first()
        if first is None:
            raise ValueError("a reconstruction needs normal rows")
        size = len(first["v"])
        draws = np.random.default_rng(seed)
        weights = draws.normal(size=(size, waves)) / (width or math.sqrt(size))
        shift = draws.uniform(0, 2 * math.pi, waves)

        row = np.array(first["v"])

        def waves_of(rows: np.ndarray) -> np.ndarray:
            return np.cos(rows @ weights + shift) * math.sqrt(2 / waves)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Row, sum and products of each wave of the rows of a task, less those of the first normal row, and their number."""
            n, total, products, base = 0, np.zeros(waves), np.zeros((waves, waves)), waves_of(row[None])[0]
            for batch in batches:
                rows = _arrow_matrix(batch.column(0))
                for at in range(0, batch.num_rows, _WAVE_ROWS):
                    made = waves_of(rows[at:at + _WAVE_ROWS]) - base
                    n, total, products = n + len(made), total + made.sum(axis=0), products + made.T @ made
            if n:
                values = pa.array(np.concatenate([products, total[:, None]], axis=1).ravel())
                sums = pa.ListArray.from_arrays(np.arange(waves + 1, dtype=np.int32) * (waves + 1), values)
                yield pa.record_batch({"wave": pa.array(np.arange(waves, dtype=np.int32)), "n": pa.array(np.full(waves, n)), "sums": sums})

        held = normal.select(vector_to_array(features).alias("v")).mapInArrow(add, "wave int, n long, sums array<double>")
        sums = [F.sum(F.col("sums")[i]) for i in range(waves + 1)]
        found = held.groupBy("wave").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums")).toArrow().sort_by("wave")
        n = found.column("n")[0].as_py()
        if n < 2:
            raise ValueError("a reconstruction needs two normal rows or more")
        added = _arrow_matrix(pa.concat_arrays(found.column("sums").chunks))
        mean = added[:, -1] / n
        spread = (added[:, :-1] - n * np.outer(mean, mean)) / (n - 1)
        components = np.linalg.eigh(spread)[1][:, ::-1][:, :min(k, waves)]
        return cls(weights, shift, mean + waves_of(row[None])[0], np.ascontiguousarray(components))

    def errors(self, rows: np.ndarray) -> np.ndarray:
        """The share of each row's centred waves that the code leaves over."""
        made = np.cos(rows @ self.weights + self.shift) * math.sqrt(2 / len(self.shift)) - self.mean
        return np.maximum((made**2).sum(axis=1) - ((made @ self.components) ** 2).sum(axis=1), 0.0)

    def score(self, df: DataFrame, features: str = "features", output: str = "error") -> DataFrame:
        """`df` with the error of the reconstruction."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def error(column: pa.Array) -> pa.Array:
            return pa.array(model.value.errors(_arrow_matrix(column)) if len(column) else np.zeros(0))

        return df.withColumn(output, error(vector_to_array(features)))
