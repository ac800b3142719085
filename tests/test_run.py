import random

import pytest

from raw_logs import raw_row, write_csv
from fraud_engine import schema as S
from fraud_engine.errors import ModelNotFound
from fraud_engine.operators.features import FeatureModel
from fraud_engine.operators.lookup import JobLookup
from fraud_engine.plans.run import run
from fraud_engine.plans.training import train_and_tune
from fraud_engine.sources import read_explanations, read_features, read_report, read_transactions
from fraud_engine.sources.readers import read_explanation_head


def log(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        fraud = int(rng.random() < 0.15)
        rows.append(raw_row(
            index=i, trans_num=f"t{seed}-{i}", cc_num=rng.randrange(30), is_fraud=fraud,
            amt=round(rng.uniform(200, 900) if fraud else rng.uniform(1, 90), 2),
            trans_date_trans_time=f"2020-06-0{rng.randrange(1, 9)} {rng.randrange(24):02d}:10:00",
            category=rng.choice(S.CATEGORIES), state=rng.choice(S.STATES),
            job=rng.choice(["Surgeon", "Engineer, electronics", "Poet"]),
            dob=f"{rng.randrange(1930, 2005)}-02-03"))
    return rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A raw log and a model trained on another one."""
    root = tmp_path_factory.mktemp("run")
    lookup = JobLookup.from_dict(spark, {
        "Healthcare_&_Medical": ["Surgeon"], "Engineering_&_Technology": ["Engineer - electronics"]})
    features = FeatureModel(S.CATEGORIES, S.STATES, S.JOB_CATEGORIES, lookup)
    train = read_transactions(spark, write_csv(root / "train.csv", log(800, 1)))
    result = train_and_tune(
        features.transform(train, keep=("trans_num",)), features.feature_columns, rounds=4, patience=2, depth=3)
    features.save(str(root / "model/features"))
    result.model.save(str(root / "model/classifier"))
    return root, write_csv(root / "log.csv", log(300, 2))


def test_full_run(spark, stored):
    root, path = stored
    paths = run(spark, path, str(root / "model"), str(root / "out"), explain_rows=7)
    features = read_features(spark, paths.features)
    assert features.count() == 300 and features.columns == ["trans_num", *S.feature_schema().names]
    assert paths.features.endswith("Processed_log.parquet")
    flagged = spark.read.parquet(paths.flagged)
    n = flagged.count()
    assert n > 10 and flagged.columns[-5:] == S.FLAGGED_EXTRA.names
    doc = read_report(spark, paths.report).first()
    assert doc["model_performance"]["fraud_detected"] == n
    assert doc["model_performance"]["total_transactions"] == 300
    assert doc["amount_analysis"]["increase_pct"] > 100
    assert read_explanation_head(spark, f"{paths.explanations}/document").first()["total_transactions"] == 7
    rows = spark.read.parquet(f"{paths.explanations}/rows")
    assert rows.select("trans_num").join(flagged, "trans_num").count() == 7
    assert {r["source"] for r in rows.collect()} == {"template"}
    top = [e["fraud_probability"] for e in read_explanations(spark, f"{paths.explanations}/document").collect()]
    assert len(top) == 7 and top == sorted(top, reverse=True)


def test_a_second_run_replaces_the_first(spark, stored):
    root, path = stored
    out = str(root / "again")
    run(spark, path, str(root / "model"), out, explain_rows=2)
    paths = run(spark, path, str(root / "model"), out, explain_rows=3)
    assert read_explanation_head(spark, f"{paths.explanations}/document").first()["total_transactions"] == 3


def test_run_without_model(spark, stored):
    root, path = stored
    with pytest.raises(ModelNotFound):
        run(spark, path, str(root / "no model"), str(root / "out2"))
