"""Evaluation of labels, predictions and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import local_table
from .ranking import exact_percentiles, running_totals, store_counts

THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _is_number(column: str) -> Column:
    """Neither null nor NaN: what has no score is left out of every measure of scores."""
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(F.lit(0.0))


def _cells(label: Column, predicted: Column, tag: str = "") -> list[Column]:
    """The four cells of the confusion matrix as aggregates of one pass."""
    return [
        F.count_if((label == actual) & (predicted == guess)).alias(name + tag)
        for name, actual, guess in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]


def confusion(df: DataFrame, label: str = S.LABEL, prediction: str = "prediction") -> DataFrame:
    """Four rows (label, prediction, n), zero counts included."""
    cells = df.agg(*_cells(F.col(label), F.col(prediction)))
    rows = [
        F.struct(F.lit(actual).alias("label"), F.lit(guess).alias("prediction"), F.col(c).alias("n"))
        for c, actual, guess in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]
    return cells.select(F.inline(F.array(*rows)))


def _report_rows(tag: str = "") -> Column:
    """Class report as an array of rows, from the cell columns with this tag."""
    tn, fp, fn, tp = (F.col(c + tag) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    n = n0 + n1
    p0, r0, p1, r1 = _ratio(tn, tn + fn), _ratio(tn, n0), _ratio(tp, tp + fp), _ratio(tp, n1)
    f0, f1 = _f1(p0, r0), _f1(p1, r1)
    accuracy = _ratio(tn + tp, n)

    def row(name, p, r, f, support):
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
            f.alias("f1"), support.alias("support"))

    def macro(a, b):
        return (a + b) / 2

    def weighted(a, b):
        return _ratio(a * n0 + b * n1, n)

    return F.array(
        row("0", p0, r0, f0, n0), row("1", p1, r1, f1, n1),
        row("accuracy", accuracy, accuracy, accuracy, n),
        row("macro avg", macro(p0, p1), macro(r0, r1), macro(f0, f1), n),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n),
    )


def class_report(df: DataFrame, label: str = S.LABEL, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages."""
    return df.agg(*_cells(F.col(label), F.col(prediction))).select(F.inline(_report_rows()))


def _sweep(df: DataFrame, thresholds: list[float], label: str, score: str) -> DataFrame:
    """One row per threshold, with its place `i` in the list.

    Rows without a score are left out. A row's level is the number of thresholds below its score, so one grouping by label and
    level counts for all thresholds; the rest works on a few groups.
    """
    level = sum(((F.col(score) > t).cast("int") for t in sorted(thresholds)), F.lit(0))
    counted = df.where(_is_number(score)).groupBy(
        F.col(label).alias("label"), level.alias("level")).agg(F.count("*").alias("n"))
    # A row that counts for nothing, so that an empty table has all its thresholds as well.
    none = df.sparkSession.range(1).select(
        F.lit(None).cast(df.schema[label].dataType).alias("label"), F.lit(0).alias("level"),
        F.lit(0).cast("long").alias("n"))
    groups = counted.unionByName(none)
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"),
                 F.lit(sum(u < t for u in thresholds)).alias("rank"))
        for i, t in enumerate(thresholds)])
    above = F.col("level") > F.col("rank")

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    fraud, normal = F.col("label") == 1, F.col("label") == 0
    cells = (
        groups.withColumn("w", F.explode(wanted)).select("label", "level", "n", "w.*")
        .groupBy("i", "threshold").agg(
            total(fraud & above, "frauds_caught"), total(fraud & ~above, "frauds_missed"),
            total(normal & above, "false_positives"), total(normal & ~above, "tn"))
    )
    tp, fn, fp = F.col("frauds_caught"), F.col("frauds_missed"), F.col("false_positives")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return cells.select(
        "i", "threshold", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"),
        "false_positives", _ratio(fp, fp + F.col("tn")).alias("false_positive_rate"),
        "frauds_caught", "frauds_missed")


def threshold_sweep(df: DataFrame, thresholds: list[float] = THRESHOLDS,
                    label: str = S.LABEL, score: str = "score") -> DataFrame:
    """Precision, recall, F1, false positives and frauds caught and missed per threshold."""
    return _sweep(df, thresholds, label, score).drop("i")


def recall_at(df: DataFrame, thresholds: list[float] = (0.3, 0.5, 0.7), **columns) -> DataFrame:
    return threshold_sweep(df, list(thresholds), **columns).select("threshold", "recall")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the best F1, the lowest threshold on ties."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def compare_thresholds(df: DataFrame, chosen: float, default: float = 0.5,
                       label: str = S.LABEL, score: str = "score") -> DataFrame:
    """Frauds caught and missed and false positives, at the default and the chosen threshold."""
    setting = F.when(F.col("i") == 0, "default").otherwise("chosen").alias("setting")
    return _sweep(df, [default, chosen], label, score).select(
        setting, "threshold", "frauds_caught", "frauds_missed", "false_positives")


def _score_counts(df: DataFrame, label: str, score: str):
    return store_counts(
        df.select(F.col(label).alias("label"), F.col(score).alias("threshold")), "threshold",
        {"pos": F.count_if(F.col("label") == 1), "neg": F.count_if(F.col("label") == 0)},
        "score_counts",
    )


def _curve(df: DataFrame, label: str, score: str, **slicing):
    counts, rows, totals = _score_counts(df, label, score)
    curve = running_totals(counts, "threshold", ["pos", "neg"], rows, **slicing)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    recall = tp / F.lit(totals["pos"]) if totals["pos"] else F.lit(1.0)
    return curve.select(
        "threshold", _ratio(tp, tp + fp).alias("precision"), recall.alias("recall"),
        "pos"), totals


def pr_curve(df: DataFrame, label: str = S.LABEL, score: str = "score", **slicing) -> DataFrame:
    """Precision and recall of `score >= threshold` at every distinct score.

    The end point (1, 0) has no threshold. Rows are collapsed to distinct scores first.
    """
    curve, _ = _curve(df, label, score, **slicing)
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return curve.drop("pos").union(end)


def average_precision(df: DataFrame, label: str = S.LABEL, score: str = "score", **slicing) -> DataFrame:
    """Sum of precision times gain in recall over the curve; 0 without positives."""
    curve, totals = _curve(df, label, score, **slicing)
    gain = F.col("pos") / F.lit(max(totals["pos"], 1))
    return curve.agg(
        F.coalesce(F.sum(gain * F.col("precision")), F.lit(0.0)).alias("average_precision"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed, empty ones included.

    Null and NaN values are left out.
    """
    df = df.where(_is_number(value))
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return local_table(df.sparkSession, [], "bin int, lower double, upper double, n long")
    width = (hi - lo) / bins or 1.0
    v = F.col(value)
    counts = (
        df.groupBy(F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    # `bins` rows, a parameter.
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("lower"),
        (lo + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def score_quartiles(df: DataFrame, label: str = S.LABEL, score: str = "score") -> DataFrame:
    """Box-plot data: minimum, quartiles and maximum of the score per class."""
    names = {0.0: "minimum", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "maximum"}
    points = exact_percentiles(df, score, list(names), group=label)
    return points.groupBy(label).agg(*[
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n) for p, n in names.items()
    ])


def compare_models(df: DataFrame, predictions: dict[str, Column], label: str = S.LABEL) -> DataFrame:
    """Fraud precision, recall and F1 per model, all models in one pass over `df`."""
    names = list(predictions)
    cells = df.agg(*[
        c for i, m in enumerate(names) for c in _cells(F.col(label), predictions[m], f"_{i}")])
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), _report_rows(f"_{i}")[1].alias("r"))
        for i, m in enumerate(names)])
    return cells.select(F.inline(rows)).select("model", "r.precision", "r.recall", "r.f1")


def best_models(comparison: DataFrame, metrics: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """The model with the highest value of each metric."""
    best = comparison.agg(
        *[F.max_by("model", F.struct(m, "model")).alias(f"{m}_model") for m in metrics],
        *[F.max(m).alias(f"{m}_value") for m in metrics])
    return best.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_model").alias("model"),
                 F.col(f"{m}_value").alias("value")) for m in metrics])))


def union_models(comparisons: list[DataFrame]) -> DataFrame:
    """Comparison rows of models that were scored on different tables."""
    return reduce(DataFrame.unionByName, comparisons)
