"""Registered queries that write files, read them back and go on, and checks of the fitted models.

The large models have no SQL form. Their queries here tell whether scores are in range and agree with the decisions
made from them; the small models of `models` are those that SQL recomputes.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import behavior, explain, lookup, metrics, ranking, report, train
from ..operators.features import FeatureModel
from ..session import materialize, run_folder
from ..sources import (
    DatasetCatalog, LoadCache, read_explanations, read_features, read_flagged, read_job_matrix, read_or_none,
    read_report, read_transactions, write_flagged, write_table,
)
from ..sources.readers import RESCUED, found_types, read_explanation_head, read_rescued
from . import queries as q
from . import models, run, txn  # noqa: F401
from .queries import QUERIES, query, rounded  # noqa: F401


def _folder(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/stored-{uuid4().hex}"


def _published(t: DataFrame) -> DataFrame:
    """The same rows with all published categories and states."""
    pick = lambda values, n: F.element_at(F.lit(values), (n % len(values) + 1).cast("int"))
    return t.withColumns({
        "category": pick(S.CATEGORIES, F.col("trans_num")), "state": pick(S.STATES, F.col("cc_num"))})


@query
def csv_features(spark, sf_dir):
    """Raw CSV log to the published feature table, with a stored feature model."""
    folder = _folder(spark)
    log = write_table(txn.raw_log(_published(txn.transactions(spark, sf_dir))), f"{folder}/log.csv", "csv")
    FeatureModel(S.CATEGORIES, S.STATES, S.JOB_CATEGORIES, txn.job_lookup(spark)).save(f"{folder}/model")
    path = run.process_transactions(spark, log, FeatureModel.load(spark, f"{folder}/model"), folder)
    return read_features(spark, path).withColumn(S.ROW_KEY, F.col(S.ROW_KEY).cast("long"))


@query
def dataset_read(spark, sf_dir):
    """A dataset by its name, through the cache of loaded tables; a missing one is None."""
    folder = _folder(spark)
    catalog, cache = DatasetCatalog(folder), LoadCache(spark)
    if cache.load(read_transactions, catalog.path("TransactionLogs-2")) is not None:
        raise AssertionError("a table was loaded that does not exist")
    path = write_table(txn.raw_log(txn.transactions(spark, sf_dir)), catalog.path("TransactionLogs-1"), "csv")
    cached = cache.load(read_transactions, path).count()
    cache.forget(path)
    read = catalog.read(spark, "TransactionLogs-1")
    return read.select(F.col(S.ROW_KEY).cast("long").alias(S.ROW_KEY), "amt", F.lit(cached).alias("cached_rows"))


@query
def matrix_csv(spark, sf_dir):
    """Job pairs to the wide matrix, as CSV, and back to pairs."""
    pairs = txn.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("job_category"), F.col("p_name").alias("job")).distinct()
    types = q.encode.fit_vocabulary(pairs, ["job_category"])["job_category"]
    path = lookup.write_matrix(pairs, types, f"{_folder(spark)}/jobs.csv")
    return lookup.matrix_to_pairs(read_job_matrix(spark, path))


@query
def flagged_stored(spark, sf_dir):
    found = q._flagged(spark, sf_dir)
    path = write_flagged(found, f"{_folder(spark)}/flagged.csv", "csv")
    return rounded(read_flagged(spark, path, found.schema, "csv"))


@query
def report_stored(spark, sf_dir):
    scored = q.score.apply_threshold(q._flags(spark, sf_dir), 0.5, "score")
    path = report.write_report(report.pattern_report(scored), f"{_folder(spark)}/report")
    return q.report_numbers(read_report(spark, path))


def _first_line(prompt: str) -> str:
    """Stands in for a text service that fails on some rows."""
    if "Category: Travel" in prompt:
        raise RuntimeError("not available")
    return f"\n Explanation: {prompt.splitlines()[1]} \n"


@query
def explanations_stored(spark, sf_dir):
    order = [F.desc("fraud_probability"), S.ROW_KEY]
    made = explain.explain(q._explainable(spark, sf_dir), 50, order, _first_line)
    path = explain.write_explanations(made, f"{_folder(spark)}/explanations")
    return rounded(read_explanations(spark, f"{path}/document"))


@query
def explanation_head(spark, sf_dir):
    """The head of a stored document, and how many rows follow it."""
    made = explain.explain(q._explainable(spark, sf_dir), 50, [F.desc("fraud_probability"), S.ROW_KEY])
    path = explain.write_explanations(made, f"{_folder(spark)}/explanations")
    rows = read_explanations(spark, f"{path}/document").count()
    return read_explanation_head(spark, f"{path}/document").select("total_transactions", F.lit(rows).cast("long").alias("n_rows"))


@query
def report_page_seek(spark, sf_dir):
    """A page by a stored index of ranks: one range of rows is read."""
    found = q._flagged(spark, sf_dir).select(S.ROW_KEY, "fraud_probability", "transaction_amount")
    index = report.PageIndex.build(found, [F.desc("fraud_probability"), S.ROW_KEY], slice_rows=50)
    return rounded(index.page(2))


@query
def card_metrics_folded(spark, sf_dir):
    """Card metrics from five logs, taken in one after the other."""
    rows = q._rows(spark, sf_dir, S.CARD).select(S.ROW_KEY, S.CARD, "amt", "txn_time", "distance")
    moments = behavior.CardMoments(spark, buckets=8)
    for k in range(5):
        moments.fold(rows.where(F.col(S.ROW_KEY) % 5 == k))
    return moments.metrics()


@query
def score_quantiles_merged(spark, sf_dir):
    """Quartiles of the score by label and hour from the sketches of four logs; groups this small have exact ones."""
    rows = q._rows(spark, sf_dir, "score").select(S.ROW_KEY, S.LABEL, "txn_time", "score")
    sketches = ranking.QuantileSketches(spark, _folder(spark), [S.LABEL, "txn_time"], k=32768)
    for k in range(4):
        sketches.fold(f"log {k}", rows.where(F.col(S.ROW_KEY) % 4 == k), "score")
    return rounded(sketches.quantiles([0.0, 0.25, 0.5, 0.75, 1.0]))


@query
def raw_types(spark, sf_dir):
    """The types that the values of a raw CSV log have, with the counts they follow from."""
    log = write_table(txn.raw_log(txn.transactions(spark, sf_dir)), f"{_folder(spark)}/log.csv", "csv")
    return found_types(spark, log).select("column", "n", "n_bigint", "n_double", "n_timestamp", "type").where(
        F.col("column").isin("trans_num", "cc_num", "category", "amt", "job", "is_fraud", "trans_date_trans_time", "city_pop"))


@query
def raw_rescued(spark, sf_dir):
    """A log with damaged amounts and hours: the values that do not fit are kept beside the row."""
    broken = F.col(S.ROW_KEY) % 7 == 0
    log = txn.raw_log(txn.transactions(spark, sf_dir)).withColumns({
        "amt": F.when(broken, F.concat(F.lit("EUR "), F.col("cc_num"))).otherwise(F.col("amt").cast("string")),
        "unix_time": F.when(broken, "soon").otherwise(F.col("unix_time").cast("string"))})
    path = write_table(log, f"{_folder(spark)}/log.csv", "csv")
    kept = F.col(RESCUED)
    return read_rescued(spark, path).select(
        F.col(S.ROW_KEY).cast("long").alias(S.ROW_KEY), F.col("amt").isNull().alias("amt_is_null"), kept["amt"].alias("rescued_amt"),
        kept["unix_time"].alias("rescued_time"), F.coalesce(F.size(F.map_keys(kept)), F.lit(0)).alias("n_rescued"))


# Fitted models


@query
def gbt_checked(spark, sf_dir):
    p = F.col("fraud_probability")
    return q._trained(spark, sf_dir).scores.select(
        S.ROW_KEY, S.LABEL, "split", p.between(0, 1).alias("in_range"),
        (F.col("prediction") == (p > 0.5).cast("int")).alias("agrees"))


@query
def gbt_importances_checked(spark, sf_dir):
    trained = q._trained(spark, sf_dir).trained
    known = F.col("feature").isin(trained.features)
    return train.feature_importances(trained).agg(
        F.count("*").alias("n"), F.round(F.sum("importance"), 6).alias("total"), F.bool_and(known).alias("named"))


@query
def iforest_checked(spark, sf_dir):
    s, d = F.col("score"), F.col("decision")
    return q.iforest_scores(spark, sf_dir).select(
        S.ROW_KEY, S.LABEL, ((s >= -1) & (s < 0)).alias("in_range"), (F.col("is_anomaly") == (d < 0).cast("int")).alias("agrees"))


@query
def pca_checked(spark, sf_dir):
    found = materialize(q.pca_anomaly(spark, sf_dir), "pca")
    n, flagged = found.agg(F.count("*"), F.sum("is_anomaly")).first()
    return found.select(
        S.ROW_KEY, S.LABEL, (F.col("error") >= 0).alias("in_range"), F.lit(0 < flagged <= 0.01 * n + 1).alias("share_is_right"))


@query
def real_models_compared(spark, sf_dir):
    """The three fitted models side by side; each on the rows it is judged on."""
    trees = q._trained(spark, sf_dir)
    tested = trees.scores.where("split = 'test'").withColumn(
        "guess", (F.col("fraud_probability") > trees.model.threshold).cast("int"))
    tables = {
        "boosted trees": tested, "isolation forest": q.iforest_scores(spark, sf_dir).withColumnRenamed("is_anomaly", "guess"),
        "reconstruction": q.pca_anomaly(spark, sf_dir).withColumnRenamed("is_anomaly", "guess")}
    return metrics.union_models([metrics.compare_models(t, {name: F.col("guess")}) for name, t in tables.items()])


@query
def full_run(spark, sf_dir):
    """Stored models, a CSV log, the full run, and for each row whether its results agree."""
    folder = _folder(spark)
    log = write_table(txn.raw_log(txn.transactions(spark, sf_dir)), f"{folder}/log.csv", "csv")
    txn.feature_model(spark, sf_dir).save(f"{folder}/model/features")
    q._trained(spark, sf_dir).model.save(f"{folder}/model/classifier")
    paths = run.run(spark, log, f"{folder}/model", f"{folder}/out", explain_rows=20)
    model = run.FraudModel.load(spark, f"{folder}/model/classifier")
    scored = model.score(read_features(spark, paths.features)).select(S.ROW_KEY, S.LABEL, "is_fraud_predicted")
    flagged = read_flagged(spark, paths.flagged).select(S.ROW_KEY, F.lit(1).alias("flagged"))
    texts = spark.read.parquet(f"{paths.explanations}/rows").select(S.ROW_KEY, F.lit(1).alias("explained"))
    report_rows = read_report(spark, paths.report).select("model_performance.total_transactions").first()[0]
    joined = scored.join(flagged, S.ROW_KEY, "left").join(texts, S.ROW_KEY, "left")
    return joined.select(
        F.col(S.ROW_KEY).cast("long").alias(S.ROW_KEY), S.LABEL,
        (F.coalesce("flagged", F.lit(0)) == F.col("is_fraud_predicted")).alias("flagged_agrees"),
        (F.coalesce("explained", F.lit(0)) <= F.col("is_fraud_predicted")).alias("explained_agrees"),
        F.lit(int(report_rows)).cast("long").alias("reported_rows"))
