import pytest
from pyspark.sql import functions as F

from fraud_engine.operators import explain
from fraud_engine.sources import read_explanations
from fraud_engine.sources.readers import read_explanation_head

SCHEMA = (
    "trans_num int, txn_time int, amt double, TXNctg_home int, TXNctg_odd_one int, "
    "`JOBctg_Legal_&_Government` int, dob_80s int, dob_00s int, avg_txn_amt double, "
    "avg_txn_time double, avg_merchant_distance double, fraud_probability double"
)


@pytest.fixture
def flagged(spark):
    return spark.createDataFrame([
        (1, 23, 304.0, 1, 0, 1, 1, 0, 100.0, 12.34, 70.0, 0.95),
        (2, 2, 50.0, 0, 1, 0, 0, 1, 100.0, 3.0, 70.0, 0.99),
        (3, 9, 20.0, 0, 0, 0, 0, 0, None, None, None, 0.91),
    ], SCHEMA)


def by_key(df):
    return {r["trans_num"]: r for r in df.collect()}


def test_names():
    assert len(explain.FEATURE_NAMES) == 32
    assert explain.feature_name("TXNctg_home", "TXNctg_") == "Home Goods"
    assert explain.feature_name("TXNctg_new", "TXNctg_") == "new"


def test_context(flagged):
    got = by_key(explain.explanation_context(flagged, keep=("trans_num",)))
    assert (got[1]["category"], got[1]["job"], got[1]["age_group"]) == (
        "Home Goods", "Legal/Government", "born in the 1980s")
    assert (got[2]["category"], got[2]["job"], got[2]["age_group"]) == (
        "odd_one", "Unknown Profession", "born in the 2000s")
    assert (got[3]["category"], got[3]["age_group"]) == ("Unknown Category", "unknown age group")
    assert [got[i]["amount_anomaly"] for i in (1, 2, 3)] == ["3.0x", "normal", "normal"]
    assert [got[i]["time_anomaly"] for i in (1, 2, 3)] == ["significant", "minor", "minor"]
    assert got[3]["user_avg_time"] == 12.0 and got[3]["amount_ratio"] == 1.0


def test_texts(flagged):
    got = by_key(explain.explanation_context(flagged, keep=("trans_num",)))[1]
    assert got["fallback"] == (
        "This $304.00 transaction was flagged due to unusual patterns: amount is 3.0x higher than "
        "typical spending and occurred at an unusual time (11:00 PM vs user's normal 0:00 PM).")
    assert "- Amount: $304.00 (user's average: $100.00)\n- Time: 11:00 PM (user's typical: 0:00 PM)" in got["prompt"]
    assert "- User Profile: Legal/Government professional, born in the 1980s\n- Fraud Confidence: 95.0%" in got["prompt"]
    assert got["summary"] == "Amount: $304.00 | Time: 11:00 PM | Category: Home Goods | Confidence: 95.0%"


def test_absent_columns_have_defaults(spark):
    df = spark.createDataFrame([(7.0, 4)], "transaction_amount double, transaction_hour int")
    got = explain.explanation_context(df).first()
    assert (got["amount"], got["time"], got["fraud_probability"]) == (7.0, 4, 0.0)
    assert explain.explanation_context(spark.range(1)).first()["time"] == 12


def test_top_rows_with_positions(flagged):
    got = explain.explain(flagged, n=2).orderBy("transaction_id").collect()
    assert [(r["transaction_id"], r["amount"]) for r in got] == [(0, 50.0), (1, 304.0)]
    assert got[1]["explanation"].startswith("This $304.00")


def test_generator_with_fallback(flagged):
    def generator(prompt):
        if "Home Goods" in prompt:
            raise RuntimeError("no answer")
        return "Explanation: odd amount. "

    got = {r["amount"]: r["explanation"] for r in explain.explain(flagged, generator=generator, tasks=2).collect()}
    assert got[50.0] == got[20.0] == "odd amount."
    assert got[304.0].startswith("This $304.00 transaction")


def whole_document(path):
    """The parts of a document behind each other, as any JSON reader sees them."""
    import json
    from pathlib import Path

    return json.loads("".join(p.read_text() for p in sorted(Path(path).glob("part-*"))))


def test_document(spark, flagged, tmp_path):
    path = explain.write_explanations(explain.explain(flagged), str(tmp_path / "e"))
    doc = whole_document(f"{path}/document")
    assert doc["total_transactions"] == 3 and doc["generated_at"]
    assert [e["transaction_id"] for e in doc["explanations"]] == [0, 1, 2]
    head = read_explanation_head(spark, f"{path}/document").first()
    assert (head["total_transactions"], head["generated_at"]) == (3, doc["generated_at"])
    rows = [r.asDict() for r in read_explanations(spark, f"{path}/document").collect()]
    assert rows == doc["explanations"]
    assert spark.read.parquet(f"{path}/rows").count() == 3


def test_document_of_many_rows_in_parts(spark, tmp_path):
    texts = F.concat(F.lit('line\n, "quoted" {"transaction_id" ]} \u2028 '), F.col("id"))
    many = spark.range(30_000).select(
        F.col("id").cast("int").alias("transaction_id"), F.lit(1.5).alias("amount"), F.lit(None).cast("int").alias("time"), F.lit("c").alias("category"),
        F.lit(0.5).alias("fraud_probability"), texts.alias("explanation")).repartition(9)
    path = explain.write_explanations(many, str(tmp_path / "many"))
    doc = whole_document(f"{path}/document")
    assert doc["total_transactions"] == 30_000 and [e["transaction_id"] for e in doc["explanations"]] == list(range(30_000))
    assert read_explanations(spark, f"{path}/document").exceptAll(many).isEmpty() and read_explanations(spark, f"{path}/document").count() == 30_000
    longest = explain.explanation_document(many).agg(F.max(F.length("line"))).first()[0]
    assert longest < 300
    empty = explain.write_explanations(many.limit(0), str(tmp_path / "none"))
    assert whole_document(f"{empty}/document")["explanations"] == []


def test_more_rows_than_a_page(spark):
    many = spark.range(12_000).select((F.col("id") / 12_000).alias("fraud_probability"), F.lit(1.0).alias("amt"))
    got = explain.explain(many, n=11_000)
    assert got.count() == 11_000
    assert explain.explanation_document(got).count() == 11_002


def test_equal_scores_are_in_order_of_the_key(spark):
    rows = spark.range(50).select(F.col("id").alias("trans_num"), F.lit(0.9).alias("fraud_probability"))
    for parts in (1, 7):
        got = explain.explain(rows.repartition(parts), n=3, keep=("trans_num",)).orderBy("transaction_id").collect()
        assert [r["trans_num"] for r in got] == [0, 1, 2]


def test_outcome_of_the_generator(spark):
    def generator(prompt):
        if "$7.00 " in prompt:
            raise RuntimeError("no service")
        return " a text "

    rows = spark.createDataFrame([(7.0, 0.9), (8.0, 0.8)], "amt double, fraud_probability double")
    got = explain.explain(rows, generator=generator, outcome=True).orderBy("transaction_id").collect()
    assert [(r["source"], r["error"]) for r in got] == [("template", "RuntimeError: no service"), ("generator", None)]
