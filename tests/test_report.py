import pytest
from pyspark.sql import functions as F

from fraud_engine import schema as S
from fraud_engine.operators import report
from fraud_engine.sources import read_report

COLUMNS = "is_fraud int, is_fraud_predicted int, txn_time int, amt double"


@pytest.fixture
def scored(spark):
    """Three fraud rows (two in travel, one at home) and one normal row."""
    df = spark.createDataFrame([(1, 1, 22, 300.0), (1, 0, 2, 100.0), (1, 1, 0, 200.0), (0, 1, 12, 50.0)], COLUMNS)
    travel = (F.col("amt") >= 200).cast("int")
    flags = [travel.alias("TXNctg_travel"), (1 - travel).alias("TXNctg_home")]
    flags += [F.lit(0).alias(c) for c in S.category_columns(["a", "b", "c", "d"])]
    return df.select("*", *flags, F.lit(1).alias("JOBctg_Legal_&_Government"), F.lit(1).alias("dob_80s"),
                     F.lit(0).alias("dob_90s"))


def test_report_sections(scored):
    doc = report.pattern_report(scored).first()
    assert doc["job_categories"] == {"JOBctg_Legal_&_Government": 3}
    assert doc["transaction_categories"] == {
        "TXNctg_travel": 2, "TXNctg_home": 1, "TXNctg_a": 0, "TXNctg_b": 0, "TXNctg_c": 0}
    assert doc["age_groups"] == {"dob_80s": 3, "dob_90s": 0}
    assert tuple(doc["amount_analysis"]) == (200.0, 50.0, 300.0)
    assert tuple(doc["time_analysis"]) == (8.0, 12.0)
    assert tuple(doc["model_performance"]) == (3, 4, 0.75)


def test_report_through_json(spark, scored, tmp_path):
    doc = report.pattern_report(scored)
    path = report.write_report(doc, str(tmp_path / "report"))
    back = read_report(spark, path)
    assert back.first().asDict(True) == doc.first().asDict(True)
    assert back.schema == S.REPORT


@pytest.mark.parametrize("condition", ["is_fraud = 1", "is_fraud = 0", "false"])
def test_report_without_one_class(scored, condition):
    doc = report.pattern_report(scored.where(condition)).first()
    assert doc["amount_analysis"]["increase_pct"] is None
    assert sum(doc["age_groups"].values()) == (3 if condition == "is_fraud = 1" else 0)
    assert (doc["model_performance"]["detection_rate"] is None) == (condition == "false")


def test_rankings_break_ties_by_name(scored):
    top = report.flag_counts(scored, "TXNctg_", 4).collect()
    assert [tuple(r) for r in top] == [
        ("TXNctg_travel", 2), ("TXNctg_home", 1), ("TXNctg_a", 0), ("TXNctg_b", 0)]
    plain = scored.withColumn("kind", F.when(F.col("amt") > 60, "x"))
    assert [tuple(r) for r in report.value_counts(plain, "kind").collect()] == [("x", 3)]


def test_shares_and_labels(scored):
    counts = report.flag_counts(scored, "TXNctg_", 2)
    share = {r["category"]: r["share_pct"] for r in report.category_share(counts).collect()}
    assert share["TXNctg_travel"] == pytest.approx(200 / 3)
    part = {r["category"]: r["vs_max"] for r in report.category_vs_max(counts).collect()}
    assert part == {"TXNctg_travel": 1.0, "TXNctg_home": 0.5}
    empty = counts.withColumn("n", F.lit(0))
    assert {r["share_pct"] for r in report.category_share(empty).collect()} == {None}
    assert {r["label"] for r in report.labelled(counts, "TXNctg_").collect()} == {"travel", "home"}


def test_pages(spark):
    df = spark.range(20)
    assert [r["id"] for r in report.page(df, 2, [F.desc("id")]).collect()] == [7, 6, 5, 4, 3, 2]
    assert report.page(df, 3, ["id"]).count() == 2
    assert tuple(report.page_count(df).first()) == (20, 4)


def test_shape(scored):
    assert tuple(report.table_shape(scored).first()) == (4, len(scored.columns))


def test_pages_by_a_stored_index(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 100 / 100).alias("p")).repartition(5)
    order = [F.desc("p"), "id"]
    index = report.PageIndex.build(rows, order, str(tmp_path / "index"), slice_rows=90)
    for number in (0, 1, 14, 15, 99, 166, 167, 5000):
        want = report.page(rows, number, order).collect()
        assert index.page(number).collect() == want
    assert index.page(3, size=250).collect() == report.page(rows, 3, order, 250).collect()
    read = {f.split("_slice=")[1].split("/")[0] for f in index.page(100).inputFiles()}
    assert len(read) >= 5  # all files are known to the table
    plan = index.page(100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_slice" in plan.split("PartitionFilters: [")[1].split("]")[0]
    ranges = spark.read.parquet(str(tmp_path / "index/ranges")).collect()
    assert sum(r["n"] for r in ranges) == 1000 and max(r["n"] for r in ranges) < 400
    empty = report.PageIndex.build(rows.limit(0), order, str(tmp_path / "none"))
    assert empty.page(0).count() == 0
