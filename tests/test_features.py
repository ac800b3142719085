import pytest
from pyspark.sql import functions as F

from raw_logs import raw_row
from fraud_engine import schema as S
from fraud_engine.operators.behavior import CardMetrics, card_metrics
from fraud_engine.operators.features import FeatureModel, drop_unused, label_first, row_features
from fraud_engine.operators.lookup import JobLookup

JOBS = {"Healthcare_&_Medical": ["Surgeon"], "Engineering_&_Technology": ["Engineer - electronics"]}


@pytest.fixture
def model(spark):
    return FeatureModel(S.CATEGORIES, S.STATES, S.JOB_CATEGORIES, JobLookup.from_dict(spark, JOBS))


def test_published_layout(raw, model):
    got = model.transform(raw([raw_row()]))
    assert len(got.columns) == 93 and got.columns[:3] == ["is_fraud", "txn_time", "amt"]
    assert got.columns[-4:] == S.CARD_METRICS and got.columns == model.schema.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in model.schema]
    row = got.first()
    assert row["txn_time"] == 13 and row["TXNctg_home"] == 1 and row["state_NY"] == 1
    assert row["JOBctg_Healthcare_&_Medical"] == 1 and row["dob_80s"] == 1


def test_flags_add_up_to_one_at_most_and_rows_are_kept(raw, model):
    rows = [raw_row(trans_num=f"t{i}", category=c, state=s, job=j, dob=d) for i, (c, s, j, d) in enumerate([
        ("home", "NY", "Surgeon", "1920-01-01"), ("never seen", "ZZ", "Poet", "1919-12-31"),
        (None, None, None, None), ("misc_net", "TX", "Engineer, electronics", "2009-12-31"),
        ("travel", "AK", "Surgeon", "2010-01-01"), ("travel", "AK", "Surgeon", "5 May 1985")])]
    got = model.transform(raw(rows), keep=("trans_num",)).orderBy("trans_num").collect()
    assert len(got) == 6

    def sums(prefix):
        return [sum(r[c] for c in r.asDict() if c.startswith(prefix)) for r in got]

    assert sums("TXNctg_") == [1, 0, 0, 1, 1, 1]
    assert sums("state_") == [1, 0, 0, 1, 1, 1]
    assert sums("JOBctg_") == [1, 0, 0, 1, 1, 1]
    assert sums("dob_") == [1, 0, 0, 1, 0, 0]
    assert got[3]["JOBctg_Engineering_&_Technology"] == 1


def test_bad_time_is_null_and_left_out_of_the_average(raw, model):
    rows = [raw_row(trans_num="a", trans_date_trans_time="bad"), raw_row(trans_num="b")]
    got = {r["trans_num"]: r for r in model.transform(raw(rows), keep=("trans_num",)).collect()}
    assert got["a"]["txn_time"] is None and got["a"]["avg_txn_time"] == 13.0


def test_card_metrics(raw):
    rows = row_features(raw([
        raw_row(trans_num="a", amt=1.0), raw_row(trans_num="b", amt=1.25), raw_row(cc_num=5, amt=3.0)]))
    got = {r["cc_num"]: r for r in card_metrics(rows).collect()}
    assert got[100]["avg_txn_amt"] == 1.13  # half up
    assert got[100]["stddev_txn_amt"] == 0.18
    assert got[5]["stddev_txn_amt"] is None


def test_means_between_two_cents_do_not_depend_on_partitions(spark):
    rows = spark.range(0, 402, 1, 1).select(
        F.lit(1).alias("cc_num"), (45 + (F.col("id") % 2) / 100).alias("amt"),
        F.lit(1).alias("txn_time"), F.lit(0.0).alias("distance"))
    for n in (1, 3, 8):
        assert card_metrics(rows.repartition(n)).first()["avg_txn_amt"] == 45.01


def test_both_ways_of_joining_metrics_agree(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 40).cast("long").alias("cc_num"),
        F.col("id").alias("trans_num"), (F.col("id") % 13).cast("double").alias("amt"),
        (F.col("id") % 24).cast("int").alias("txn_time"), F.sqrt("id").alias("distance"))
    metrics = CardMetrics.fit(rows)
    columns = ["trans_num", "cc_num", *S.CARD_METRICS]
    small = sorted(metrics.attach(rows).select(*columns).collect())
    large = sorted(metrics.attach(rows, slice_hot=True, parts=10).select(*columns).collect())
    assert small == large and len(small) == 2000


def test_metrics_can_come_from_another_table(raw, spark, model, tmp_path):
    from raw_logs import write_csv
    from fraud_engine.sources import read_transactions

    train = read_transactions(spark, write_csv(tmp_path / "train.csv", [raw_row(amt=50.0), raw_row(amt=70.0)]))
    got = model.transform(raw([raw_row(amt=10.0), raw_row(cc_num=9)]), fit_on=train).collect()
    assert sorted((r["avg_txn_amt"] for r in got), key=str) == [60.0, None]


def test_parsing_once_changes_nothing(raw, model):
    df = raw([raw_row(amt=10.0), raw_row(cc_num=9, state=None)])
    assert sorted(model.transform(df, parse_once=True).collect()) == sorted(model.transform(df).collect())


def test_distance_is_kept_on_request_only(raw, model):
    df = raw([raw_row()])
    assert "distance" not in model.transform(df).columns
    assert "distance" in model.transform(df, keep_distance=True).columns


def test_vocabularies_are_learnt_when_not_given(raw, spark):
    df = raw([raw_row(category="misc, net", state="TX"), raw_row(), raw_row(category=None, state=None)])
    matrix = spark.createDataFrame([("Surgeon", "Poet")], "`Health care` string, Arts string")
    model = FeatureModel.from_matrix(df, matrix)
    assert model.categories == ["home", "misc - net"] and model.states == ["NY", "TX"]
    got = model.transform(df)
    assert {"TXNctg_misc - net", "state_TX", "JOBctg_Health_care"} <= set(got.columns)
    assert got.agg(F.sum("`JOBctg_Health_care`")).first()[0] == 3


def test_save_and_load(raw, spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    back = FeatureModel.load(spark, str(tmp_path / "m"))
    assert (back.categories, back.states, back.job_categories) == (
        model.categories, model.states, model.job_categories)
    df = raw([raw_row()])
    assert back.transform(df).collect() == model.transform(df).collect()


def test_a_table_without_label(raw, model):
    got = model.transform(raw([raw_row()]).drop("is_fraud"))
    assert got.columns == model.feature_columns


def test_drop_unused_and_label_first(raw):
    df = label_first(drop_unused(raw([raw_row()])))
    assert df.columns[0] == "is_fraud" and "merchant" not in df.columns and len(df.columns) == 12
    assert label_first(df.drop("is_fraud")).columns == df.columns[1:]


def test_features_without_rows(raw, model):
    got = model.transform(raw([]))
    assert got.count() == 0 and len(got.columns) == 93
