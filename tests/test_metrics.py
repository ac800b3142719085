import numpy as np
import pytest
from pyspark.sql import functions as F

from fraud_engine.operators import metrics
from fraud_engine.operators.ranking import exact_percentiles, running_totals

# Published results: TN, FP, FN, TP with precision, recall, F1.
MATRICES = [
    ((255603, 2231, 56, 1445), (0.3931, 0.9627, 0.5582)),
    ((257342, 492, 161, 1340), (0.7314, 0.8927, 0.8041)),
]
# Published sweep: threshold, TP, FP, FN, precision, recall, F1, FPR, with 257,834 negatives.
SWEEP = [
    (0.1, 1481, 8401, 20, 0.1499, 0.9867, 0.2602, 0.0326),
    (0.2, 1472, 5281, 29, 0.2180, 0.9807, 0.3567, 0.0205),
    (0.3, 1464, 3843, 37, 0.2759, 0.9753, 0.4301, 0.0149),
    (0.4, 1448, 2925, 53, 0.3311, 0.9647, 0.4930, 0.0113),
    (0.5, 1441, 2268, 60, 0.3885, 0.9600, 0.5532, 0.0088),
    (0.6, 1430, 1756, 71, 0.4488, 0.9527, 0.6102, 0.0068),
    (0.7, 1414, 1296, 87, 0.5218, 0.9420, 0.6716, 0.0050),
    (0.8, 1397, 897, 104, 0.6090, 0.9307, 0.7362, 0.0035),
    (0.9, 1338, 488, 163, 0.7327, 0.8914, 0.8043, 0.0019),
]
NEGATIVES, POSITIVES = 257834, 1501


def expand(spark, groups):
    """Rows (is_fraud, prediction, score) from (label, prediction, score, n)."""
    df = spark.createDataFrame(groups, "is_fraud int, prediction int, score double, n int")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("i", "n")


def published(spark, cells):
    tn, fp, fn, tp = cells
    return expand(spark, [(0, 0, 0.0, tn), (0, 1, 1.0, fp), (1, 0, 0.0, fn), (1, 1, 1.0, tp)])


@pytest.mark.parametrize("cells, ratios", MATRICES)
def test_published_confusion_and_report(spark, cells, ratios):
    df = published(spark, cells)
    got = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion(df).collect()}
    assert got == dict(zip([(0, 0), (0, 1), (1, 0), (1, 1)], cells))
    report = {r["class"]: r for r in metrics.class_report(df).collect()}
    fraud = report["1"]
    assert (round(fraud["precision"], 4), round(fraud["recall"], 4), round(fraud["f1"], 4)) == ratios
    assert fraud["support"] == POSITIVES and report["0"]["support"] == NEGATIVES
    assert report["accuracy"]["f1"] == pytest.approx((cells[0] + cells[3]) / sum(cells))
    assert report["macro avg"]["recall"] == pytest.approx(
        (report["0"]["recall"] + fraud["recall"]) / 2)
    assert report["weighted avg"]["precision"] == pytest.approx(
        (report["0"]["precision"] * NEGATIVES + fraud["precision"] * POSITIVES) / sum(cells))


@pytest.fixture(scope="module")
def published_scores(spark):
    """Scores between the thresholds, so that every published row comes out."""
    groups = []
    for label, column, total in ((1, 1, POSITIVES), (0, 2, NEGATIVES)):
        above = [row[column] for row in SWEEP]
        levels = [total - above[0], *[a - b for a, b in zip(above, above[1:])], above[-1]]
        groups += [(label, 0, 0.05 + 0.1 * i, n) for i, n in enumerate(levels)]
    return expand(spark, groups).cache()


def test_published_sweep(published_scores):
    got = sorted(metrics.threshold_sweep(published_scores).collect())
    for row, (t, tp, fp, fn, p, r, f1, fpr) in zip(got, SWEEP, strict=True):
        assert (row["threshold"], row["frauds_caught"], row["false_positives"], row["frauds_missed"]) == (t, tp, fp, fn)
        assert [round(row[c], 4) for c in ("precision", "recall", "f1", "false_positive_rate")] == [p, r, f1, fpr]


def test_published_best_threshold(published_scores):
    best = metrics.best_threshold(metrics.threshold_sweep(published_scores)).first()
    assert best["threshold"] == 0.9 and round(best["f1"], 3) == 0.804


def test_default_and_chosen(published_scores):
    got = {r["setting"]: r for r in metrics.compare_thresholds(published_scores, 0.9).collect()}
    assert (got["default"]["frauds_caught"], got["default"]["false_positives"]) == (1441, 2268)
    assert (got["chosen"]["frauds_caught"], got["chosen"]["false_positives"]) == (1338, 488)
    same = metrics.compare_thresholds(published_scores, 0.5).collect()
    assert {r["setting"] for r in same} == {"default", "chosen"}


def test_recall_at(published_scores):
    got = {r["threshold"]: round(r["recall"], 4) for r in metrics.recall_at(published_scores).collect()}
    assert got == {0.3: 0.9753, 0.5: 0.96, 0.7: 0.942}


def test_score_equal_to_the_threshold_is_not_flagged(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.4)], "is_fraud int, score double")
    assert metrics.threshold_sweep(df, [0.5]).first()["frauds_caught"] == 0


def test_best_threshold_on_ties_is_the_lowest(spark):
    sweep = spark.createDataFrame([(0.5, 0.7), (0.3, 0.7), (0.1, 0.2)], "threshold double, f1 double")
    assert metrics.best_threshold(sweep).first()["threshold"] == 0.3


@pytest.mark.parametrize("label", [0, 1])
def test_only_one_class(spark, label):
    df = spark.createDataFrame([(label, 0, 0.2), (label, 0, 0.6)], "is_fraud int, prediction int, score double")
    report = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert report["1"]["precision"] == 0.0 and report["1"]["f1"] == 0.0
    row = metrics.threshold_sweep(df, [0.9]).first()
    assert (row["precision"], row["recall"], row["f1"], row["false_positive_rate"]) == (0, 0, 0, 0)


def scored(spark, n=5000, values=700):
    """Skewed scores with many ties: half the rows share one score."""
    rng = np.random.default_rng(1)
    s = np.where(rng.random(n) < 0.5, 0.001, rng.integers(0, values, n) / values)
    y = (rng.random(n) < 0.1 + 0.5 * s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "is_fraud int, score double")
    return df, y, s


def brute_curve(y, s):
    points = []
    for t in np.unique(s):
        flagged = s >= t
        points.append((t, y[flagged].mean(), y[flagged].sum() / y.sum()))
    return points


@pytest.mark.parametrize("slice_rows", [200_000, 20])
def test_pr_curve_and_average_precision(spark, slice_rows):
    df, y, s = scored(spark)
    want = brute_curve(y, s)
    rows = metrics.pr_curve(df, slice_rows=slice_rows).collect()
    end = [r for r in rows if r["threshold"] is None]
    assert [tuple(r)[1:] for r in end] == [(1.0, 0.0)]
    got = sorted(tuple(r) for r in rows if r["threshold"] is not None)
    assert np.allclose(got, want)
    recalls = [0.0] + [r for _, _, r in reversed(want)]
    ap = sum((b - a) * p for a, b, (_, p, _) in zip(recalls, recalls[1:], reversed(want)))
    assert metrics.average_precision(df, slice_rows=slice_rows).first()[0] == pytest.approx(ap)


def test_curve_without_positives(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4)], "is_fraud int, score double")
    assert metrics.average_precision(df).first()[0] == 0.0
    assert {r["recall"] for r in metrics.pr_curve(df).collect()} == {0.0, 1.0}


def test_running_totals_in_slices(spark):
    values = spark.range(1000).select((F.col("id") / 7).alias("x"), (F.col("id") % 5).alias("n"))
    got = running_totals(values, "x", ["n"], 1000, slice_rows=37).orderBy(F.desc("x")).collect()
    want = np.cumsum([i % 5 for i in reversed(range(1000))])
    assert [r["cum_n"] for r in got] == want.tolist()


PROBABILITIES = [0.0, 0.02, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("slice_rows", [200_000, 50])
@pytest.mark.parametrize("kind", ["ties", "heavy", "negative", "constant", "one", "decades"])
def test_exact_percentiles(spark, kind, slice_rows):
    rng = np.random.default_rng(3)
    x = {
        "ties": np.where(rng.random(3000) < 0.4, 0.25, rng.random(3000).round(2)),
        "heavy": np.exp(rng.normal(0, 6, 3000)),
        "negative": -rng.random(2000),
        "constant": np.full(50, 2.5),
        "one": np.array([3.0]),
        "decades": 10.0 ** rng.uniform(-100, 100, 3000),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    got = {r["probability"]: r["value"] for r in exact_percentiles(df, "x", PROBABILITIES, slice_rows=slice_rows).collect()}
    assert list(got) == PROBABILITIES
    assert np.allclose(list(got.values()), np.percentile(x, [100 * p for p in PROBABILITIES]), rtol=1e-12)


def test_percentiles_per_group(spark):
    df, y, s = scored(spark, 2000)
    got = {r["is_fraud"]: r for r in metrics.score_quartiles(df).collect()}
    for label in (0, 1):
        want = np.percentile(s[y == label], [0, 25, 50, 75, 100])
        assert np.allclose([got[label][c] for c in ("minimum", "q1", "median", "q3", "maximum")], want)


def test_percentiles_with_infinite_values(spark):
    x = [float("inf"), float("-inf")] + [float(i) for i in range(20_000)]
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(4)
    got = [r["value"] for r in exact_percentiles(df, "x", [0.0, 0.5, 0.9, 1.0], slice_rows=3000).collect()]
    assert got == [float("-inf"), 9999.5, pytest.approx(np.percentile(x, 90)), float("inf")]


def test_percentiles_of_many_groups(spark):
    df = spark.range(50_000).select((F.col("id") % 5000).alias("g"), F.col("id").cast("double").alias("x"))
    got = {r["g"]: r["value"] for r in exact_percentiles(df, "x", [0.5], group="g", slice_rows=7000).collect()}
    assert len(got) == 5000 and all(v == 22_500.0 + g for g, v in got.items())


def test_scores_that_are_not_numbers_are_left_out(spark):
    df, y, s = scored(spark, 1000)
    more = df.select("is_fraud", "score").union(spark.createDataFrame([(1, float("nan")), (0, None)], "is_fraud int, score double"))
    for slice_rows in (200_000, 20):
        assert metrics.average_precision(more, slice_rows=slice_rows).first()[0] == pytest.approx(
            metrics.average_precision(df).first()[0])
    assert metrics.threshold_sweep(more).collect() == metrics.threshold_sweep(df).collect()
    assert metrics.histogram(more, "score").collect() == metrics.histogram(df, "score").collect()


def test_sweep_of_an_empty_table(spark):
    got = metrics.threshold_sweep(spark.createDataFrame([], "is_fraud int, score double"))
    assert got.count() == 9 and got.agg(F.sum("frauds_caught"), F.max("f1")).first() == (0, 0.0)
    assert metrics.best_threshold(got).first()["threshold"] == 0.1


def test_percentiles_without_rows(spark):
    assert exact_percentiles(spark.createDataFrame([], "x double"), "x", [0.5]).count() == 0


def test_histogram(spark):
    df, _, s = scored(spark, 2000)
    n, edges = np.histogram(s, bins=50)
    got = metrics.histogram(df, "score").orderBy("bin").collect()
    assert [r["n"] for r in got] == n.tolist()
    assert np.allclose([r["lower"] for r in got], edges[:-1])
    same = metrics.histogram(spark.createDataFrame([(1.0,), (1.0,)], "score double"), "score", 3)
    assert [r["n"] for r in same.orderBy("bin").collect()] == [2, 0, 0]
    assert metrics.histogram(spark.createDataFrame([], "score double"), "score").count() == 0


def test_model_comparison(spark):
    df = published(spark, (90, 10, 5, 15)).withColumn("other", F.lit(1))
    table = metrics.compare_models(df, {"a": F.col("prediction"), "b": F.col("other")})
    got = {r["model"]: r for r in table.collect()}
    assert got["a"]["precision"] == 0.6 and got["a"]["recall"] == 0.75 and got["b"]["recall"] == 1.0
    best = {r["metric"]: r["model"] for r in metrics.best_models(table).collect()}
    assert best == {"precision": "a", "recall": "b", "f1": "a"}
    assert metrics.union_models([table, table]).count() == 4


def test_sketches_of_parts_merge(spark, tmp_path):
    from fraud_engine.operators.ranking import QuantileSketches

    rng = np.random.default_rng(7)
    parts = [spark.createDataFrame([(int(g), float(v)) for g, v in zip(rng.integers(0, 2, n), rng.lognormal(0, 2, n))], "g int, v double")
             for n in (20_000, 50, 30_000)]
    sketches = QuantileSketches(spark, str(tmp_path / "s"), ["g"], k=1024)
    for k, part in enumerate(parts):
        sketches.fold(f"log/{k}", part, "v")
    sketches.fold("log/1", parts[1], "v")  # again: it replaces the first
    values = np.sort(np.concatenate([[r["v"] for r in p.collect()] for p in parts]))
    for r in sketches.quantiles([0.01, 0.5, 0.99, 0.999], by=[]).collect():
        rank = np.searchsorted(values, r["value"], side="right") / len(values)
        assert r["n"] == len(values) and abs(rank - r["probability"]) < 2.3 / 1024**0.9
    assert sketches.quantiles([0.5]).count() == 2
    rank = sketches.rank_of(float(values[25_025]), by=[]).first()["rank"]
    assert abs(rank - 0.5) < 2.3 / 1024**0.9


def test_sketches_of_few_values_are_exact(spark, tmp_path):
    from fraud_engine.operators.ranking import QuantileSketches

    df = spark.createDataFrame([(i % 3, None if i % 10 == 0 else float(i)) for i in range(600)] + [(None, 5.0), (0, float("nan"))], "g int, v double")
    sketches = QuantileSketches(spark, str(tmp_path / "s"), ["g"])
    sketches.fold("a", df.where("v < 200 OR v IS NULL"), "v").fold("b", df.where("v >= 200"), "v")
    got = {(r["g"], r["probability"]): r["value"] for r in sketches.quantiles([0.0, 0.25, 1.0]).collect()}
    for g in (0, 1, 2):
        v = sorted(i for i in range(600) if i % 3 == g and i % 10)
        assert [got[g, p] for p in (0.0, 0.25, 1.0)] == [v[0], v[int(np.ceil(len(v) / 4)) - 1], v[-1]]
    assert got[None, 0.25] == 5.0
