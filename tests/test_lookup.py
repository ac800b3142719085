import pytest
from pyspark.sql import functions as F

from fraud_engine.operators.encode import distinct_values, fit_vocabulary, one_hot
from fraud_engine.operators.joins import hot_keys, left_lookup
from fraud_engine.operators.lookup import JobLookup, matrix_to_pairs, pairs_to_matrix, write_matrix
from fraud_engine.sources import read_job_matrix

JOBS = {"Business_&_Management": ["Dealer", "Barista"], "Legal_&_Government": ["Lawyer"]}


def test_matrix_to_pairs_drops_blanks_and_repeats(spark):
    wide = spark.createDataFrame(
        [("Dealer", "Lawyer"), ("Barista", None), ("Dealer", "")],
        "`Business_&_Management` string, `Legal_&_Government` string")
    assert {tuple(r) for r in matrix_to_pairs(wide).collect()} == {
        ("Business_&_Management", "Dealer"), ("Business_&_Management", "Barista"),
        ("Legal_&_Government", "Lawyer")}


def test_pairs_to_matrix_and_back(spark):
    pairs = JobLookup.from_dict(spark, JOBS).pairs
    wide = pairs_to_matrix(pairs, list(JOBS))
    rows = wide.orderBy("position").collect()
    assert [tuple(r)[1:] for r in rows] == [("Barista", "Lawyer"), ("Dealer", "")]
    back = matrix_to_pairs(wide.drop("position")).select("job", "job_category")
    assert sorted(back.collect()) == sorted(pairs.collect())


def test_matrix_through_csv(spark, tmp_path):
    pairs = JobLookup.from_dict(spark, JOBS).pairs
    path = write_matrix(pairs, list(JOBS), str(tmp_path / "jobs"))
    wide = read_job_matrix(spark, path)
    assert wide.columns == list(JOBS)
    back = matrix_to_pairs(wide).select("job", "job_category")
    assert sorted(back.collect()) == sorted(pairs.collect())


def test_a_job_in_two_categories_is_refused(spark):
    with pytest.raises(ValueError, match="two categories"):
        JobLookup.from_dict(spark, {"A": ["x"], "B": ["x"]})


def test_unmatched_and_null_jobs_have_no_category(spark):
    txn = spark.createDataFrame([(1, "Lawyer"), (2, "Poet"), (3, None)], "id int, job string")
    got = JobLookup.from_dict(spark, JOBS).attach(txn)
    assert {(r["id"], r["job_category"]) for r in got.collect()} == {
        (1, "Legal_&_Government"), (2, None), (3, None)}


def skewed(spark):
    """A third of the rows on one key, a tenth without key."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 50)
    return spark.range(3000).select("id", key.cast("long").alias("k"))


def test_join_of_a_large_lookup_equals_the_plain_join(spark):
    fact = skewed(spark)
    dim = spark.range(0, 45).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = fact.join(dim, "k", "left").select("id", "k", "v").collect()
    sliced = left_lookup(fact, dim, "k", slice_hot=True, parts=20)
    assert sorted(sliced.select("id", "k", "v").collect(), key=lambda r: r["id"]) == sorted(
        plain, key=lambda r: r["id"])
    assert left_lookup(fact, dim, "k").count() == 3000


def test_rows_of_a_hot_key_are_spread(spark):
    fact = skewed(spark)
    counts = fact.groupBy("k").agg(F.count("*").alias("n"))
    hot = {r["k"]: r["_slices"] for r in hot_keys(counts, "k", parts=20).collect()}
    assert hot == {7: 7}
    assert hot_keys(counts.limit(0), "k").count() == 0


def test_vocabulary(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 1)], "s string, n int")
    assert fit_vocabulary(df, ["s", "n"]) == {"s": ["a", "b"], "n": ["1", "2"]}
    assert distinct_values(df, ["s"]).count() == 2
    with pytest.raises(ValueError, match="distinct values"):
        fit_vocabulary(spark.range(100).select(F.col("id").cast("string").alias("s")), ["s"], 99)
    assert len(fit_vocabulary(spark.range(6000), ["id"])["id"]) == 6000


def test_hot_keys_come_from_the_rows_that_are_joined(spark):
    fact = spark.range(3000).select("id", F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).cast("long").alias("k"))
    dim = spark.range(0, 10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = left_lookup(fact, dim, "k", slice_hot=True, parts=20)
    assert joined.count() == 3000 and joined.where("v = 1").count() == 1500


def test_matrix_of_many_pairs(spark):
    pairs = spark.range(250_000).select(
        F.when(F.col("id") % 5 == 0, "small").otherwise("large").alias("job_category"),
        F.format_string("%08d", F.col("id")).alias("job"))
    got = pairs_to_matrix(pairs, ["large", "small"])
    assert got.count() == 200_000
    assert tuple(got.where("position = 49999").select("large", "small").first()) == ("00062499", "00249995")
    assert got.where("position = 50000").first()["small"] == ""


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "s string")
    got = one_hot(df, "s", ["a", "b"], ["is_a", "is_b"]).collect()
    assert [tuple(r) for r in got] == [("a", 1, 0), ("z", 0, 0), (None, 0, 0)]
