"""Card metrics that are kept and brought up to date log by log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraud_engine.operators.behavior import CardMoments, card_metrics
from fraud_engine.session import folders_in

COLUMNS = "cc_num long, amt double, txn_time int, distance double"


def log(spark, n, seed, cards=40):
    rng = np.random.default_rng(seed)
    rows = [(None if c == 0 else int(c), None if rng.random() < 0.05 else float(rng.normal(60, 20)), int(rng.integers(0, 24)),
             None if rng.random() < 0.05 else float(rng.random() * 90)) for c in rng.integers(0, cards, n)]
    return spark.createDataFrame(rows, COLUMNS)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_five_logs_equal_one_pass(spark, tmp_path):
    logs = [log(spark, n, k, cards) for k, (n, cards) in enumerate([(500, 40), (1, 40), (300, 90), (0, 3), (700, 40)])]
    moments = CardMoments(spark, str(tmp_path / "m"), buckets=4)
    whole = None
    for one in logs:
        moments.fold(one)
        whole = one if whole is None else whole.unionByName(one)
        assert collected(moments.metrics()) == collected(card_metrics(whole))
    assert len(folders_in(spark, str(tmp_path / "m"), "_SUCCESS")) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("card_moments")]


def test_large_values_with_small_spread(spark, tmp_path):
    """Sums of squares would lose all digits here."""
    logs = [spark.createDataFrame([(1, 1e9 + i % 3, 1, 1.0) for i in range(k, 300, 3)], COLUMNS) for k in range(3)]
    moments = CardMoments(spark, str(tmp_path / "m"), buckets=2)
    for one in logs:
        moments.fold(one)
    row = moments.table().first()["amt"]
    values = [1e9 + i % 3 for i in range(300)]
    assert row["n"] == 300 and row["mean"] == pytest.approx(np.mean(values), abs=1e-6) and row["m2"] == pytest.approx(np.var(values) * 300, rel=1e-6)


def test_a_fold_that_breaks_off_can_be_repeated(spark, tmp_path):
    first, second = log(spark, 200, 1), log(spark, 200, 2)
    moments = CardMoments(spark, str(tmp_path / "m"), buckets=2).fold(first)
    broken = second.withColumn("amt", F.when(F.col("amt") > 0, F.raise_error(F.lit("gone"))).otherwise(0.0))
    with pytest.raises(Exception, match="gone"):
        moments.fold(broken)
    assert collected(moments.metrics()) == collected(card_metrics(first))
    again = CardMoments(spark, str(tmp_path / "m"), buckets=2).fold(second)
    assert collected(again.metrics()) == collected(card_metrics(first.unionByName(second)))


def test_stored_moments_are_not_moved(spark, tmp_path, monkeypatch):
    """The join with a new log sorts and shuffles the new side only."""
    moments = CardMoments(spark, str(tmp_path / "m"), buckets=4).fold(log(spark, 300, 1))
    plans, real = [], type(spark.range(1)).repartition

    def repartition(self, *args):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return real(self, *args)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(type(spark.range(1)), "repartition", repartition)
        moments.fold(log(spark, 300, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = plans[-1]
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    old_side = plan.split("SortMergeJoin")[1].split("FileScan")[0].splitlines()
    assert not any("Exchange" in line for line in old_side[:6])
