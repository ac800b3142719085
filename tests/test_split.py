import hashlib

import pytest
from pyspark.sql import functions as F

from fraud_engine.operators import split


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20000).select(
        F.col("id").alias("trans_num"), (F.col("id") % 50 == 0).cast("int").alias("is_fraud")).cache()


def digest(key):
    return hashlib.md5(f"42{key}".encode()).hexdigest()


def test_hash_cut():
    assert split.hash_cut(0.2) == "33333333" and split.hash_cut(0.4) == "66666666"


def test_hash_split_follows_the_key_alone(rows):
    got = {r["trans_num"]: r["split"] for r in split.hash_split(rows.repartition(7)).collect()}
    for key in range(0, 20000, 371):
        h = digest(key)
        assert got[key] == ("test" if h < "33333333" else "validation" if h < "66666666" else "train")
    assert len(got) == 20000


def test_hash_split_keeps_the_fraud_rate(rows):
    got = {r["split"]: r for r in split.split_rates(split.hash_split(rows)).collect()}
    assert set(got) == {"train", "validation", "test"}
    for part, share in (("train", 0.6), ("validation", 0.2), ("test", 0.2)):
        assert got[part]["n"] / 20000 == pytest.approx(share, abs=0.02)
        assert got[part]["fraud_rate"] == pytest.approx(0.02, abs=0.006)


@pytest.mark.parametrize("parts", [split.THREE_WAY, split.TWO_WAY])
def test_exact_split_equals_ranking_all_rows(rows, parts):
    got = {r["trans_num"]: r["split"] for r in split.exact_split(rows, parts).collect()}
    for label in (0, 1):
        keys = sorted((k for k in range(20000) if (k % 50 == 0) == label), key=digest)
        start = 0
        upto = 0.0
        for name, share in parts.items():
            upto += share
            end = int(len(keys) * upto + 0.5)
            assert {got[k] for k in keys[start:end]} == {name}
            start = end
        assert {got[k] for k in keys[start:]} == {"train"}


def test_exact_split_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1)], "trans_num int, is_fraud int")
    got = split.exact_split(df).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got}["test"] == 1
    assert sum(r["count"] for r in got) == 6


def test_rates(spark, rows):
    assert tuple(split.label_rate(rows).first()) == (20000, 0.02)
    assert tuple(split.class_ratio(rows).first()) == (19600, 400, 49.0)
    assert split.class_ratio(rows.where("is_fraud = 0")).first()["ratio"] is None
