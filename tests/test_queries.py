"""Every registered query against its SQL twin, and the shape of those without one."""

from pathlib import Path

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from check_queries import differences, oracle_connection
from fraud_engine.plans.model_oracle import MODEL_ORACLE
from fraud_engine.plans.oracle import ORACLE
from fraud_engine.plans.stored import QUERIES

pytestmark = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="no test data")
ROWS_ONLY = {
    "gbt_fit", "gbt_two_way", "gbt_scores", "gbt_importances", "gbt_tuned_report", "gbt_checked", "gbt_importances_checked",
    "iforest_fit", "iforest_scores", "iforest_importances", "iforest_checked", "pca_anomaly", "pca_checked", "curved_anomaly", "real_models_compared",
}


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SMOKE_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, SMOKE_DIR).toPandas()
    assert differences(got, duck.execute(oracle_sql()[name]).fetchdf()) == []


def test_models_alone_have_no_sql():
    assert set(QUERIES) - set(ORACLE) - set(MODEL_ORACLE) == ROWS_ONLY


@pytest.mark.parametrize("name, rows", [
    ("gbt_scores", 1000), ("gbt_tuned_report", 5), ("gbt_two_way", 3), ("iforest_scores", 1000), ("pca_anomaly", 1000), ("curved_anomaly", 1000), ("real_models_compared", 3)])
def test_model_queries_run(spark, name, rows):
    assert queries()[name](spark, SMOKE_DIR).count() == rows


@pytest.mark.parametrize("name", ["gbt_checked", "iforest_checked"])
def test_decisions_agree_with_scores(spark, name):
    assert queries()[name](spark, SMOKE_DIR).where("in_range AND agrees").count() == 1000


def test_models_are_fitted_again_when_the_files_change(spark, tmp_path):
    import os
    import shutil

    from fraud_engine.plans import queries as q

    for name in q.txn.SCHEMAS:
        shutil.copy(f"{SMOKE_DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    fits = []
    fit = lambda: fits.append(1) or len(fits)
    assert [q._once(spark, str(tmp_path), "kind", fit) for _ in range(2)] == [1, 1]
    os.utime(tmp_path / "events.parquet", (1, 1))
    assert q._once(spark, str(tmp_path), "kind", fit) == 2


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 1000 and df.columns[:4] == ["trans_num", "is_fraud", "txn_time", "amt"]
