"""Small models whose every number SQL can recompute: trees boosted for two rounds, a forest of four trees, a code of one.

They run the library's own training and scoring over all transactions; only settings are small, so that their twins can
write every level of every tree out.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import anomaly, boosting, train
from ..session import materialize, run_folder
from ..sources import read_flagged, read_report, write_table
from . import queries as q
from . import run, txn
from .queries import query, rounded

# Values after which the boosted trees may split.
CUTS = {"amt": [20.0, 60.0, 120.0, 160.0, 250.0], "txn_time": [5.0, 11.0, 17.0], "birth_year": [1939.0, 1959.0, 1979.0]}
BOOST = boosting.Settings(rounds=2, depth=2, row_share=1.0, column_share=1.0)
# Those of the columns of the feature table, for a full run.
RUN_CUTS = {c: CUTS[c] for c in ("amt", "txn_time")}
TREES, SAMPLE, SEED = 4, 32, 42


def _boosted(spark, sf_dir) -> tuple[boosting.BoostedTrees, DataFrame]:
    rows = q._rows(spark, sf_dir).select(S.ROW_KEY, S.LABEL, *CUTS)
    found = boosting.fit(rows, None, list(CUTS), settings=BOOST, cuts=[np.array(c) for c in CUTS.values()])
    return found.model, rows


@query
def boosted_nodes(spark, sf_dir):
    """Every node: split, side of missing values, value, gain, cover."""
    return rounded(_boosted(spark, sf_dir)[0].table(spark))


@query
def boosted_scores(spark, sf_dir):
    model, rows = _boosted(spark, sf_dir)
    scored = q.score.with_probability(model, rows)
    return rounded(scored.select(S.ROW_KEY, S.LABEL, "fraud_probability", "prediction"))


@query
def boosted_importances(spark, sf_dir):
    return rounded(_boosted(spark, sf_dir)[0].importances(spark))


def _forest(spark, sf_dir) -> tuple[anomaly.IsolationForest, DataFrame]:
    """Four trees, each on the rows with the lowest draws of tree and key; the draws are ones that SQL has."""
    features = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CUTS])
    rows = materialize(q._rows(spark, sf_dir).select(S.ROW_KEY, S.LABEL, features.alias("features")), "small-rows")
    share = min(1.0, 3 * SAMPLE / max(rows.count(), 1))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("sample"), F.col("tree"), F.col(S.ROW_KEY))), 1, 13), 16, 10).cast("long")
    # Three times the sample: more than enough of the lowest.
    samples = rows.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), S.ROW_KEY, "features").select(
        "tree", draw.alias("order"), "features").where(F.col("order") <= F.lit(share * 2.0**52))
    return anomaly.IsolationForest.grow(samples, TREES, SAMPLE, SEED), rows


@query
def isolation_nodes(spark, sf_dir):
    nodes = _forest(spark, sf_dir)[0].nodes
    return rounded(nodes.select("tree", "node", "feature", "threshold", "n", "depth", "impurity"))


@query
def isolation_scores(spark, sf_dir):
    forest, rows = _forest(spark, sf_dir)
    return rounded(forest.score(rows).select(S.ROW_KEY, S.LABEL, "score"))


@query
def isolation_importances(spark, sf_dir):
    return rounded(_forest(spark, sf_dir)[0].importances(list(CUTS)))


@query
def reconstruction_errors(spark, sf_dir):
    """The error of a code of width 1 of two standardised features, learnt from normal rows."""
    rows = q._rows(spark, sf_dir).select(S.ROW_KEY, S.LABEL, "txn_time", "amt")
    ready = train.fit_preparation(rows, ["txn_time", "amt"])
    vectors = materialize(ready.transform(rows).select(S.ROW_KEY, S.LABEL, "features"), "small-vectors")
    found = anomaly.ReconstructionModel.fit(vectors, k=1).score(vectors)
    v = vector_to_array("features")
    return rounded(found.select(S.ROW_KEY, S.LABEL, v[0].alias("txn_time_scaled"), "error"))


@query
def run_flagged(spark, sf_dir):
    """A CSV log through the full run with a stored two-round model: the flagged rows, with the numbers of the report."""
    folder = f"{run_folder(spark)}/small-run-{uuid4().hex}"
    stored = materialize(txn.features(spark, sf_dir, keep=(S.ROW_KEY,)), "features")
    found = boosting.fit(stored, None, list(RUN_CUTS), settings=BOOST, cuts=[np.array(c) for c in RUN_CUTS.values()])
    txn.feature_model(spark, sf_dir).save(f"{folder}/model/features")
    q.score.FraudModel(found.model, 0.5).save(f"{folder}/model/classifier")
    log = write_table(txn.raw_log(txn.transactions(spark, sf_dir)), f"{folder}/log.csv", "csv")
    paths = run.run(spark, log, f"{folder}/model", f"{folder}/out", explain_rows=5)
    told = read_report(spark, paths.report).select(
        F.col("model_performance.fraud_detected").alias("reported_flagged"), F.col("model_performance.total_transactions").alias("reported_total"))
    flagged = read_flagged(spark, paths.flagged).select(
        F.col(S.ROW_KEY).cast("long").alias(S.ROW_KEY), "fraud_probability", "is_fraud_predicted", "is_fraud_actual", "transaction_amount", "transaction_hour")
    return rounded(flagged.crossJoin(F.broadcast(told)))
