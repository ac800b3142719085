"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import schema as S
from ..operators import (
    anomaly, behavior, encode, explain, features, lookup, metrics, ranking, report, score, split,
    train,
)
from ..session import materialize
from . import training, txn

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PLACES = 6


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def _rows(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return features.row_features(txn.transactions(spark, sf_dir), keep)


def _predicted(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    return txn.transactions(spark, sf_dir).select(
        S.LABEL, "score", fn.above_threshold("score", threshold).alias("prediction"))


# Row features


@query
def raw_columns(spark, sf_dir):
    t = features.drop_unused(txn.transactions(spark, sf_dir))
    t = t.withColumn("trans_date_trans_time", fn.hour_of_day("trans_date_trans_time"))
    t = t.withColumnRenamed("trans_date_trans_time", "txn_time")
    return features.label_first(t.withColumn("dob", F.col("dob").cast("string")))


@query
def hour_of_day(spark, sf_dir):
    return _rows(spark, sf_dir).select(S.ROW_KEY, "txn_time")


@query
def comma_clean(spark, sf_dir):
    return _rows(spark, sf_dir).select(S.ROW_KEY, "category", "job")


@query
def dob_decade_flags(spark, sf_dir):
    return _rows(spark, sf_dir).select(S.ROW_KEY, "birth_year", *features.decade_flags())


@query
def txn_distance(spark, sf_dir):
    return rounded(_rows(spark, sf_dir).select(S.ROW_KEY, "distance"))


@query
def onehot_category(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(S.ROW_KEY, "category")
    return encode.one_hot(
        rows, "category", txn.CATEGORIES, S.category_columns(txn.CATEGORIES)).drop("category")


@query
def onehot_state(spark, sf_dir):
    states = txn.feature_model(spark, sf_dir).states
    rows = _rows(spark, sf_dir).select(S.ROW_KEY, "state")
    return encode.one_hot(rows, "state", states, S.state_columns(states)).drop("state")


@query
def onehot_job(spark, sf_dir):
    joined = txn.job_lookup(spark).attach(_rows(spark, sf_dir))
    return encode.one_hot(
        joined.select(S.ROW_KEY, "job_category"), "job_category", S.JOB_CATEGORIES,
        S.job_columns(S.JOB_CATEGORIES)).drop("job_category")


@query
def vocabulary(spark, sf_dir):
    return encode.distinct_values(_rows(spark, sf_dir), ["category", "state", "job"])


# Card behaviour and lookup


@query
def card_metrics(spark, sf_dir):
    return behavior.card_metrics(_rows(spark, sf_dir))


@query
def txn_with_metrics(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return behavior.CardMetrics.fit(rows).attach(rows).select(S.ROW_KEY, S.CARD, *S.CARD_METRICS)


@query
def txn_with_metrics_sliced(spark, sf_dir):
    """The same join with the rows of hot cards spread over slices."""
    rows = _rows(spark, sf_dir)
    joined = behavior.CardMetrics.fit(rows).attach(rows, slice_hot=True)
    return joined.select(S.ROW_KEY, S.CARD, *S.CARD_METRICS)


@query
def metrics_from_train(spark, sf_dir):
    """Card metrics of the training rows, joined to all rows."""
    rows = split.hash_split(_rows(spark, sf_dir))
    fitted = behavior.CardMetrics.fit(rows.where("split = 'train'"))
    return fitted.attach(rows).select(S.ROW_KEY, S.CARD, "split", *S.CARD_METRICS)


@query
def job_category_join(spark, sf_dir):
    return txn.job_lookup(spark).attach(_rows(spark, sf_dir)).select(S.ROW_KEY, "job", "job_category")


@query
def lookup_unpivot(spark, sf_dir):
    wide = txn.table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")
    return lookup.matrix_to_pairs(wide)


@query
def lookup_pivot(spark, sf_dir):
    pairs = txn.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("job_category"), F.col("p_name").alias("job")).distinct()
    types = encode.fit_vocabulary(pairs, ["job_category"])["job_category"]
    return lookup.pairs_to_matrix(pairs, types)


@query
def features_full(spark, sf_dir):
    return txn.features(spark, sf_dir, keep=(S.ROW_KEY,))


# Evaluation of the stand-in score


@query
def confusion(spark, sf_dir):
    return metrics.confusion(_predicted(spark, sf_dir))


@query
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(_predicted(spark, sf_dir)))


@query
def threshold_sweep(spark, sf_dir):
    return rounded(metrics.threshold_sweep(_predicted(spark, sf_dir)))


@query
def recall_at_thresholds(spark, sf_dir):
    return rounded(metrics.recall_at(_predicted(spark, sf_dir)))


@query
def best_threshold(spark, sf_dir):
    return rounded(metrics.best_threshold(metrics.threshold_sweep(_predicted(spark, sf_dir))))


@query
def default_vs_best(spark, sf_dir):
    scored = _predicted(spark, sf_dir)
    chosen = metrics.best_threshold(metrics.threshold_sweep(scored)).first()["threshold"]
    return metrics.compare_thresholds(scored, chosen)


@query
def pr_curve(spark, sf_dir):
    return rounded(metrics.pr_curve(_predicted(spark, sf_dir)), 9)


@query
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(_predicted(spark, sf_dir)), 9)


@query
def score_histogram(spark, sf_dir):
    return rounded(metrics.histogram(_predicted(spark, sf_dir), "score"))


@query
def score_quartiles(spark, sf_dir):
    return rounded(metrics.score_quartiles(_predicted(spark, sf_dir)))


@query
def score_percentiles(spark, sf_dir):
    return rounded(ranking.exact_percentiles(
        _predicted(spark, sf_dir), "score", [0.02, 0.05, 0.5, 0.95, 0.99]))


@query
def percentile_cut(spark, sf_dir):
    t = txn.transactions(spark, sf_dir).select(S.ROW_KEY, F.col("amt").alias("error"))
    return anomaly.flag_highest(t).select(S.ROW_KEY, "is_anomaly")


@query
def contamination_cut(spark, sf_dir):
    t = txn.transactions(spark, sf_dir).select(S.ROW_KEY, (-F.col("amt")).alias("score"))
    return rounded(anomaly.flag_lowest(t).select(S.ROW_KEY, "decision", "is_anomaly"))


def _compared(spark, sf_dir):
    t = txn.transactions(spark, sf_dir).select(S.LABEL, "score", "category")
    return metrics.compare_models(t, {
        "score above 0.5": fn.above_threshold("score", 0.5),
        "score above 0.2": fn.above_threshold("score", 0.2),
        "travel": (F.col("category") == "travel").cast("int"),
    })


@query
def model_comparison(spark, sf_dir):
    return rounded(_compared(spark, sf_dir))


@query
def best_models(spark, sf_dir):
    return rounded(metrics.best_models(_compared(spark, sf_dir)))


# Report tables


@query
def table_shape(spark, sf_dir):
    return report.table_shape(txn.transactions(spark, sf_dir))


@query
def label_rate(spark, sf_dir):
    return rounded(split.label_rate(txn.transactions(spark, sf_dir)))


@query
def class_ratio(spark, sf_dir):
    return rounded(split.class_ratio(txn.transactions(spark, sf_dir)))


def _flags(spark, sf_dir):
    rows = txn.job_lookup(spark).attach(_rows(spark, sf_dir, "score"))
    flagged = encode.one_hot(
        rows, "category", txn.CATEGORIES, S.category_columns(txn.CATEGORIES))
    flagged = encode.one_hot(
        flagged, "job_category", S.JOB_CATEGORIES, S.job_columns(S.JOB_CATEGORIES))
    return flagged.select("*", *features.decade_flags()).drop(
        "category", "state", "job", "job_category", "birth_year", "distance", S.CARD)


@query
def top_job_categories(spark, sf_dir):
    return report.flag_counts(_flags(spark, sf_dir), S.JOB_PREFIX, 5)


@query
def top_txn_categories(spark, sf_dir):
    return report.flag_counts(_flags(spark, sf_dir), S.CATEGORY_PREFIX, 5)


@query
def age_groups(spark, sf_dir):
    return report.flag_counts(_flags(spark, sf_dir), S.DECADE_PREFIX)


@query
def category_counts(spark, sf_dir):
    return report.value_counts(_rows(spark, sf_dir), "category")


@query
def amount_analysis(spark, sf_dir):
    return rounded(report.amount_analysis(txn.transactions(spark, sf_dir)))


@query
def time_analysis(spark, sf_dir):
    return rounded(report.time_analysis(_rows(spark, sf_dir)))


@query
def category_share(spark, sf_dir):
    ages = report.category_share(report.flag_counts(_flags(spark, sf_dir), S.DECADE_PREFIX))
    return rounded(report.labelled(ages, S.DECADE_PREFIX, upper=True))


@query
def category_vs_max(spark, sf_dir):
    top = report.category_vs_max(report.flag_counts(_flags(spark, sf_dir), S.CATEGORY_PREFIX, 5))
    return rounded(report.labelled(top, S.CATEGORY_PREFIX))


@query
def pattern_report(spark, sf_dir):
    scored = score.apply_threshold(_flags(spark, sf_dir), 0.5, "score")
    return report_numbers(report.pattern_report(scored))


def report_numbers(document: DataFrame) -> DataFrame:
    """The report document with one row per number."""
    maps = ["job_categories", "transaction_categories", "age_groups"]
    structs = ["amount_analysis", "time_analysis", "model_performance"]
    entry = "array<struct<name:string,value:double>>"

    def numbers(section: str) -> Column:
        if section in maps:
            entries = F.map_entries(section).cast(entry)
        else:
            entries = F.array(*[
                F.struct(F.lit(f.name).alias("name"),
                         F.col(f"{section}.{f.name}").cast("double").alias("value"))
                for f in S.REPORT[section].dataType.fields])
        return F.transform(entries, lambda x: F.struct(
            F.lit(section).alias("section"), x["name"].alias("name"), x["value"].alias("value")))

    rows = F.flatten(F.array(*[numbers(s) for s in maps + structs]))
    return rounded(document.select(F.inline(rows)))


def _flagged(spark, sf_dir):
    rows = _flags(spark, sf_dir).withColumnRenamed("score", "fraud_probability")
    return score.flagged_transactions(score.apply_threshold(rows, 0.5), S.ROW_KEY)


@query
def score_summary(spark, sf_dir):
    return rounded(score.score_summary(
        score.apply_threshold(txn.transactions(spark, sf_dir), 0.5, "score"), "score"))


@query
def flagged(spark, sf_dir):
    return rounded(_flagged(spark, sf_dir))


@query
def flagged_top10(spark, sf_dir):
    return rounded(_flagged(spark, sf_dir).limit(10).select(
        S.ROW_KEY, "fraud_probability", "transaction_amount", "transaction_hour"))


@query
def report_page(spark, sf_dir):
    found = _flagged(spark, sf_dir).select(S.ROW_KEY, "fraud_probability", "transaction_amount")
    return rounded(report.page(found, 2, [F.desc("fraud_probability"), S.ROW_KEY]))


@query
def page_count(spark, sf_dir):
    return report.page_count(_flagged(spark, sf_dir))


# Splits and scaling


@query
def split_hash_counts(spark, sf_dir):
    return rounded(split.split_rates(split.hash_split(txn.transactions(spark, sf_dir))))


@query
def split_two_way(spark, sf_dir):
    return split.hash_split(txn.transactions(spark, sf_dir), split.TWO_WAY, "train").select(
        S.ROW_KEY, "split")


@query
def split_exact_counts(spark, sf_dir):
    parts = split.exact_split(txn.transactions(spark, sf_dir))
    return parts.groupBy("split", S.LABEL).agg(F.count("*").alias("n"))


@query
def split_exact_two_way(spark, sf_dir):
    parts = split.exact_split(txn.transactions(spark, sf_dir), split.TWO_WAY)
    return rounded(split.split_rates(parts))


@query
def split_exact_rows(spark, sf_dir):
    return split.exact_split(txn.transactions(spark, sf_dir)).select(S.ROW_KEY, "split")


@query
def scaled_features(spark, sf_dir):
    rows = split.hash_split(_rows(spark, sf_dir).select(S.ROW_KEY, "txn_time", "amt"))
    ready = train.fit_preparation(rows.where("split = 'train'"), ["txn_time", "amt"])
    v = vector_to_array("features")
    return rounded(ready.transform(rows).select(
        S.ROW_KEY, v[0].alias("txn_time_scaled"), v[1].alias("amt_scaled")))


# Models: no SQL twin


def _stored_features(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    stored = materialize(txn.features(spark, sf_dir, keep=(S.ROW_KEY,)), "features")
    return stored, [c for c in stored.columns if c not in (S.ROW_KEY, S.LABEL)]


_models: dict[tuple[str, str, str], object] = {}


def _signature(spark, sf_dir: str) -> str:
    """Names, lengths and times of the files that the transactions come from."""
    make, seen = spark._jvm.org.apache.hadoop.fs.Path, []
    for name in ("events", "customer", "nation"):
        top = make(f"{sf_dir}/{name}.parquet")
        found = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
        while found.hasNext():
            status = found.next()
            seen.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return "\n".join(sorted(seen))


def _once(spark, sf_dir: str, kind: str, fit: Callable[[], object], anew: bool = False) -> object:
    """A model is fitted once for each application and state of the files, and its queries share it."""
    key = (spark.sparkContext.applicationId, _signature(spark, sf_dir), kind)
    if anew or key not in _models:
        _models[key] = fit()
    return _models[key]


def _trained(spark, sf_dir, anew: bool = False) -> training.TrainingResult:
    return _once(spark, sf_dir, "boosted trees", lambda: _train(spark, sf_dir), anew)


def _train(spark, sf_dir) -> training.TrainingResult:
    stored, inputs = _stored_features(spark, sf_dir)
    return training.train_and_tune(stored, inputs)


@query
def gbt_fit(spark, sf_dir):
    """The nodes of the model of the 60/20/20 protocol, always fitted anew; the queries below share it."""
    return _trained(spark, sf_dir, anew=True).trained.trees.table(spark)


@query
def gbt_two_way(spark, sf_dir):
    """The 70/30 protocol: recall of fraud at three thresholds."""
    stored, inputs = _stored_features(spark, sf_dir)
    return training.train_two_way(stored, inputs).sweep


@query
def gbt_scores(spark, sf_dir):
    return _trained(spark, sf_dir).scores


@query
def gbt_importances(spark, sf_dir):
    return train.feature_importances(_trained(spark, sf_dir).trained, 20)


@query
def gbt_tuned_report(spark, sf_dir):
    return _trained(spark, sf_dir).tuned_report()


def _vectors(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    stored, inputs = _stored_features(spark, sf_dir)
    ready = train.fit_preparation(stored, inputs)
    return ready.transform(stored).select(S.ROW_KEY, S.LABEL, "features"), inputs


def _forest(spark, sf_dir, anew: bool = False):
    return _once(spark, sf_dir, "isolation forest", lambda: _grow(spark, sf_dir), anew)


def _grow(spark, sf_dir):
    rows, inputs = _vectors(spark, sf_dir)
    rows = rows.withColumn("features", vector_to_array("features"))
    return anomaly.IsolationForest.fit(rows), rows, inputs


@query
def iforest_fit(spark, sf_dir):
    """The nodes of the forest, always grown anew; the queries below share it."""
    return _forest(spark, sf_dir, anew=True)[0].nodes


@query
def iforest_scores(spark, sf_dir):
    forest, rows, _ = _forest(spark, sf_dir)
    scored = materialize(forest.score(rows).drop("features"), "isolation_scores")
    return anomaly.flag_lowest(scored)


@query
def iforest_importances(spark, sf_dir):
    forest, _, inputs = _forest(spark, sf_dir)
    return forest.importances(inputs, 20)


@query
def pca_anomaly(spark, sf_dir):
    rows, _ = _vectors(spark, sf_dir)
    model = anomaly.ReconstructionModel.fit(rows)
    scored = materialize(model.score(rows).drop("features"), "reconstruction_errors")
    return anomaly.flag_highest(scored)


@query
def curved_anomaly(spark, sf_dir):
    rows, _ = _vectors(spark, sf_dir)
    model = anomaly.CurvedReconstruction.fit(rows)
    scored = materialize(model.score(rows).drop("features"), "curved_errors")
    return anomaly.flag_highest(scored)


# Explanations


def _explainable(spark, sf_dir) -> DataFrame:
    """Flagged rows of the full feature table, with the stand-in score."""
    model = txn.feature_model(spark, sf_dir)
    keep = (S.ROW_KEY, "score")
    rows = model.transform(txn.transactions(spark, sf_dir), keep=keep)
    scored = score.apply_threshold(rows.withColumnRenamed("score", "fraud_probability"), 0.5)
    return score.flagged_transactions(scored, ordered=False)


@query
def explanation_context(spark, sf_dir):
    context = explain.explanation_context(_explainable(spark, sf_dir), keep=(S.ROW_KEY,))
    return rounded(context.select(
        S.ROW_KEY, "amount", "time", "category", "job", "age_group", "user_avg_amount",
        "user_avg_time", "user_avg_distance", "fraud_probability", "amount_ratio", "time_anomaly",
        "time_text", "usual_time_text"))


@query
def explanation_texts(spark, sf_dir):
    return explain.explanation_context(_explainable(spark, sf_dir), keep=(S.ROW_KEY,)).select(
        S.ROW_KEY, "amount_anomaly", "prompt", "fallback", "summary")


@query
def explanation_sample(spark, sf_dir):
    """Summary lines of the first three flagged rows."""
    order = [F.desc("fraud_probability"), S.ROW_KEY]
    top = explain.top_flagged(_explainable(spark, sf_dir), 3, order)
    return explain.explanation_context(top, keep=("transaction_id",)).select("transaction_id", "summary")


@query
def explanations(spark, sf_dir):
    return rounded(explain.explain(
        _explainable(spark, sf_dir), 50, [F.desc("fraud_probability"), S.ROW_KEY]))
