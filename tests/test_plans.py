"""What the plans must and must not contain."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR, queries
from fraud_engine.operators.behavior import card_metrics
from fraud_engine.operators.metrics import threshold_sweep
from fraud_engine.operators.split import hash_split

needs_data = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="no test data")


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@needs_data
def test_features_stay_in_the_jvm_without_shuffle(spark, capsys):
    text = plan(queries()["features_full"](spark, SMOKE_DIR), capsys)
    assert "Python" not in text and "Sort" not in text
    # Small lookups: every exchange is a broadcast.
    assert not re.search(r"^[ +:-]*Exchange", text, re.M)


@needs_data
@pytest.mark.parametrize("name, columns", [
    ("hour_of_day", {"event_id", "ts", "user_id"}),
    ("label_rate", {"user_id", "event_type", "value", "props"}),
    ("amount_analysis", {"user_id", "event_type", "value", "props"}),
])
def test_scans_read_the_needed_columns(spark, capsys, name, columns):
    text = plan(queries()[name](spark, SMOKE_DIR), capsys)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_hash_split_needs_no_shuffle(spark, capsys):
    df = spark.range(10).select(F.col("id").alias("trans_num"))
    assert "Exchange" not in plan(hash_split(df), capsys)


def test_sweep_counts_before_the_shuffle(spark, capsys):
    df = spark.range(10).select((F.col("id") % 2).alias("is_fraud"), (F.col("id") / 10).alias("score"))
    text = plan(threshold_sweep(df), capsys)
    assert "partial_count" in text and len(re.findall(r"^[ +:-]*Exchange", text, re.M)) == 2


def test_skewed_join_under_card_metrics_is_split(spark, tmp_path):
    """Half of all rows belong to one card, and the card table is too large to broadcast."""
    rows = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 500).alias("cc_num"),
        (F.col("id") % 101).cast("double").alias("amt"), (F.col("id") % 24).cast("int").alias("txn_time"))
    rows.write.parquet(str(tmp_path / "txn"))
    spark.range(500).select(F.col("id").alias("cc_num"), (F.col("id") / 3).alias("distance")).write.parquet(
        str(tmp_path / "cards"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    joined = spark.read.parquet(str(tmp_path / "txn")).join(spark.read.parquet(str(tmp_path / "cards")), "cc_num")
    want = sorted(card_metrics(joined).collect())
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = card_metrics(joined)
        assert sorted(got.collect()) == want
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
