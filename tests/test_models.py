import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from fraud_engine.errors import ModelNotFound
from fraud_engine.operators import anomaly, train
from fraud_engine.operators.score import (
    FraudModel, apply_threshold, flagged_transactions, score_summary, with_probability,
)
from fraud_engine.plans.training import train_and_tune, train_two_way

INPUTS = ["txn_time", "amt", "TXNctg_home", "stddev_txn_amt"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 3000
    fraud = rng.random(n) < 0.08
    amt = np.where(fraud, rng.normal(400, 150, n), rng.normal(60, 40, n))
    rows = [
        (i, int(f), int(rng.integers(0, 24)), float(a), int(rng.integers(0, 2)),
         None if i % 50 == 0 else float(rng.random()))
        for i, (f, a) in enumerate(zip(fraud, amt))]
    return spark.createDataFrame(
        rows, "trans_num int, is_fraud int, txn_time int, amt double, TXNctg_home int, stddev_txn_amt double").cache()


def test_scaler_uses_the_training_rows(table):
    half = table.where("trans_num < 1500")
    ready = train.fit_preparation(half, INPUTS)
    got = ready.transform(half).select(vector_to_array("features").alias("f")).select(
        F.avg(F.col("f")[1]), F.stddev_samp(F.col("f")[1]), F.avg(F.col("f")[3])).first()
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(1) and got[2] == pytest.approx(0, abs=1e-9)
    other = ready.transform(table).select(F.avg(vector_to_array("features")[1])).first()[0]
    assert abs(other) > 1e-6


@pytest.fixture(scope="module")
def result(table):
    return train_and_tune(table, INPUTS, rounds=8, patience=2, depth=3)


def test_training_protocol(result):
    assert 1 <= result.trained.rounds <= len(result.trained.losses) <= 8
    assert result.scores.groupBy("split").count().count() == 3
    lo, hi = result.scores.agg(F.min("fraud_probability"), F.max("fraud_probability")).first()
    assert 0 <= lo < hi <= 1
    assert result.sweep.count() == 9
    best = result.sweep.agg(F.max("f1")).first()[0]
    assert best > 0.8
    assert result.sweep.where(F.col("threshold") == result.model.threshold).first()["f1"] == best
    assert result.default_confusion().agg(F.sum("n")).first()[0] == result.scores.where("split = 'test'").count()
    assert result.tuned_confusion().count() == 4 and result.comparison().count() == 2
    assert result.default_report().count() == result.tuned_report().count() == 5


def test_preparation_without_holes_or_without_values(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 0, None)], "TXNctg_home int, is_fraud int, amt double")
    for inputs in (["TXNctg_home"], ["TXNctg_home", "amt"]):
        assert train.fit_preparation(df, inputs).transform(df).count() == 2


def test_early_protocol(table):
    got = train_two_way(table, INPUTS, rounds=3, depth=3)
    assert got.model.threshold == 0.5 and got.sweep.count() == 3
    assert {r["split"] for r in got.scores.select("split").distinct().collect()} == {"train", "test"}


def test_importances(result):
    got = train.feature_importances(result.trained)
    assert got.first()["feature"] == "amt" and got.count() == len(INPUTS)
    assert got.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert train.feature_importances(result.trained, 2).count() == 2


def test_one_class_cannot_be_trained(table):
    with pytest.raises(ValueError, match="both classes"):
        train.fit_boosted_trees(table.where("is_fraud = 0"), None, INPUTS, rounds=1)


def test_stored_model_scores_alike(spark, table, result, tmp_path):
    result.model.save(str(tmp_path / "m"))
    back = FraudModel.load(spark, str(tmp_path / "m"))
    assert back.threshold == result.model.threshold
    a = back.score(table).select("trans_num", "fraud_probability", "is_fraud_predicted")
    b = result.model.score(table).select("trans_num", "fraud_probability", "is_fraud_predicted")
    assert sorted(a.collect()) == sorted(b.collect())


def test_missing_model(spark, tmp_path):
    with pytest.raises(ModelNotFound):
        FraudModel.load(spark, str(tmp_path / "nothing"))
    spark.range(1).selectExpr("0.5D AS threshold").write.parquet(str(tmp_path / "half/threshold"))
    with pytest.raises(ModelNotFound):
        FraudModel.load(spark, str(tmp_path / "half"))


def test_flagged_rows(table, result):
    scored = apply_threshold(with_probability(result.trained.trees, table), 0.5)
    found = flagged_transactions(scored, "trans_num")
    rows = found.collect()
    p = [r["fraud_probability"] for r in rows]
    assert p == sorted(p, reverse=True) and min(p) > 0.5
    assert found.columns == ["trans_num", *INPUTS, "fraud_probability", "is_fraud_predicted",
                             "is_fraud_actual", "transaction_amount", "transaction_hour"]
    assert all(r["transaction_amount"] == r["amt"] and r["is_fraud_predicted"] == 1 for r in rows)
    summary = score_summary(scored).first()
    assert summary["flagged"] == len(rows) and summary["total"] == 3000
    assert summary["max_score"] == p[0]


# Anomaly detectors


@pytest.fixture(scope="module")
def points(spark):
    """A cloud of normal rows and twenty outliers."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6))
    x[:, 3] = x[:, 0] * 2
    x[:, 4] = x[:, 1] - x[:, 2]
    x[:20] += rng.choice([-8, 8], size=(20, 6))
    rows = [(i, int(i < 20), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "trans_num int, is_fraud int, features array<double>").cache()


@pytest.fixture(scope="module")
def forest(points):
    return anomaly.IsolationForest.fit(points, trees=40, sample=64)


def test_trees_have_their_sample(forest):
    roots = forest.nodes.where("node = 0").collect()
    assert len(roots) == 40 and {r["n"] for r in roots} == {64}
    assert forest.nodes.agg(F.max("depth")).first()[0] <= 6
    leaves = forest.nodes.where("feature < 0").groupBy("tree").agg(F.sum("n").alias("n"))
    assert {r["n"] for r in leaves.collect()} == {64}


def test_scores_equal_walking_the_nodes(forest, points):
    nodes = {(r["tree"], r["node"]): r for r in forest.nodes.collect()}
    for row in forest.score(points).limit(30).collect():
        lengths = []
        for tree in range(40):
            at = nodes[(tree, 0)]
            while at["feature"] >= 0:
                side = "left" if row["features"][at["feature"]] <= at["threshold"] else "right"
                at = nodes[(tree, at[side])]
            lengths.append(at["depth"] + float(anomaly.mean_path(at["n"])))
        want = -2 ** (-np.mean(lengths) / float(anomaly.mean_path(64)))
        assert row["score"] == pytest.approx(want)


def test_outliers_score_lower(forest, points):
    got = forest.score(points).groupBy("is_fraud").agg(F.avg("score").alias("s")).collect()
    s = {r["is_fraud"]: r["s"] for r in got}
    assert s[1] < s[0] - 0.1
    flagged = anomaly.flag_lowest(forest.score(points), 0.02)
    assert flagged.agg(F.sum("is_anomaly")).first()[0] == 30
    assert flagged.where("is_anomaly = 1 AND is_fraud = 1").count() >= 18


def test_forest_does_not_depend_on_partitions(points, forest):
    other = anomaly.IsolationForest.fit(points.repartition(7), trees=40, sample=64)
    assert sorted(other.nodes.collect()) == sorted(forest.nodes.collect())
    third = anomaly.IsolationForest.fit(points, trees=40, sample=64, seed=1)
    assert sorted(third.nodes.collect()) != sorted(forest.nodes.collect())


def test_trees_draw_independently_from_all_rows(points):
    rows = points.count()
    drawn = anomaly.sample_per_tree(points, "features", "trans_num", 60, 16, 42)
    per_tree = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    share = (16 + 6 * 4) / rows
    assert len(per_tree) == 60 and abs(np.mean(per_tree) - share * rows) < 4 * np.sqrt(share * rows / 60)
    pairs = drawn.alias("a").join(drawn.alias("b"), F.col("a.features") == F.col("b.features")).where("a.tree < b.tree").count()
    expected = 60 * 59 / 2 * share**2 * rows
    assert abs(pairs - expected) < 6 * np.sqrt(expected)


def test_forest_over_fewer_rows_than_the_sample(points):
    few = points.limit(10)
    forest = anomaly.IsolationForest.fit(few, trees=5)
    assert {r["n"] for r in forest.nodes.where("node = 0").collect()} == {10}
    lo, hi = forest.score(few).agg(F.min("score"), F.max("score")).first()
    assert -1 <= lo <= hi < 0


def test_forest_importances_are_decreases_of_impurity(forest):
    names, want = list("abcdef"), np.zeros(6)
    nodes = {(r["tree"], r["node"]): r for r in forest.nodes.collect()}
    for tree in range(40):
        own, held = np.zeros(6), lambda n, t=tree: nodes[t, n]["n"] * nodes[t, n]["impurity"]
        for (t, n), r in nodes.items():
            if t == tree and r["feature"] >= 0:
                own[r["feature"]] += held(n) - held(r["left"]) - held(r["right"])
        want += own / own.sum() / 40
    got = {r["feature"]: r["importance"] for r in forest.importances(names).collect()}
    assert got == {n: pytest.approx(w) for n, w in zip(names, want)}


def test_impurity_is_the_variance_of_the_targets():
    x, order = np.array([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0], [4.0, 5.0]]), np.array([9, 3, 7, 1])
    nodes = anomaly._grow(3, x, order, 42, 2)
    y = np.array([anomaly._draw(42, 3, "y", o) for o in order])
    root = nodes[nodes["node"] == 0].iloc[0]
    assert root["feature"] == 0 and root["impurity"] == pytest.approx(y.var()) and 1 <= root["threshold"] < 4
    for _, r in nodes.iterrows():
        if r["node"] in (1, 2):
            own = (x[:, 0] <= root["threshold"]) == (r["node"] == 1)
            assert r["n"] == own.sum() and r["impurity"] == pytest.approx(y[own].var())


def test_forest_importances_and_storage(spark, forest, tmp_path):
    names = list("abcdef")
    got = forest.importances(names)
    assert got.count() == 6 and got.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert forest.importances(names, 2).count() == 2
    forest.save(str(tmp_path / "f"))
    back = anomaly.IsolationForest.load(spark, str(tmp_path / "f"))
    assert sorted(back.nodes.collect()) == sorted(forest.nodes.collect()) and back.trees == 40


def test_reconstruction_error(points):
    df = points.withColumn("features", array_to_vector("features"))
    model = anomaly.ReconstructionModel.fit(df, k=4)
    pc = model.pca.pc.toArray()
    for row in model.score(df).limit(50).collect():
        z = row["features"].toArray()
        assert row["error"] == pytest.approx(np.mean((z - pc @ (pc.T @ z)) ** 2), abs=1e-9)
    s = {r["is_fraud"]: r["e"] for r in model.score(df).groupBy("is_fraud").agg(F.avg("error").alias("e")).collect()}
    assert s[1] > 10 * s[0]


def test_flag_highest(spark):
    df = spark.range(1, 201).select(F.col("id").cast("double").alias("error"))
    assert anomaly.flag_highest(df).agg(F.sum("is_anomaly")).first()[0] == 2
    assert anomaly.flag_highest(df, exact=False).agg(F.sum("is_anomaly")).first()[0] in (1, 2, 3)


@pytest.fixture(scope="module")
def ring(spark):
    """Normal rows on a circle and outliers inside it, where no flat code finds them."""
    rng = np.random.default_rng(2)
    turn = rng.uniform(0, 2 * np.pi, 1500)
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1) * 1.4 + rng.normal(0, 0.05, (1500, 2))
    x[:15] = rng.normal(0, 0.2, (15, 2))
    return spark.createDataFrame([(i, int(i < 15), [float(v) for v in r]) for i, r in enumerate(x)],
                                 "trans_num int, is_fraud int, features array<double>").withColumn("features", array_to_vector("features")).cache()


def test_a_curved_surface_is_found(ring):
    def caught(model):
        scored = model.score(ring).select("is_fraud", "error").toPandas()
        cut = np.sort(scored["error"])[-15]
        return int(scored.loc[scored["is_fraud"] == 1, "error"].ge(cut).sum())

    assert caught(anomaly.ReconstructionModel.fit(ring, k=1)) < 5
    assert caught(anomaly.CurvedReconstruction.fit(ring, k=8, waves=128, width=0.7)) >= 14


def test_curved_errors_equal_numpy(ring):
    model = anomaly.CurvedReconstruction.fit(ring, k=5, waves=32)
    rows = ring.toPandas()
    z = np.stack([v.toArray() for v in rows["features"]])
    waves = np.cos(z @ model.weights + model.shift) * np.sqrt(2 / 32)
    normal = waves[rows["is_fraud"] == 0]
    values, vectors = np.linalg.eigh(np.cov(normal.T))
    top = vectors[:, np.argsort(-values)[:5]]
    centred = waves - normal.mean(axis=0)
    want = ((centred - centred @ top @ top.T) ** 2).sum(axis=1)
    got = [r["error"] for r in model.score(ring).orderBy("trans_num").collect()]
    assert np.allclose(got, want, atol=1e-9)
    again = anomaly.CurvedReconstruction.fit(ring.repartition(7), k=5, waves=32)
    assert np.allclose([r["error"] for r in again.score(ring).orderBy("trans_num").collect()], got, atol=1e-9)
    with pytest.raises(ValueError, match="normal rows"):
        anomaly.CurvedReconstruction.fit(ring.where("is_fraud = 1"))


def test_waves_are_not_stored(spark, ring):
    from fraud_engine.session import folders_in, run_folder

    anomaly.CurvedReconstruction.fit(ring, k=3, waves=16)
    assert [p for p in folders_in(spark, run_folder(spark)) if "/waves-" in p] == []


def test_waves_of_equal_rows_and_of_one_row(ring):
    same = ring.where("is_fraud = 0").withColumn("features", array_to_vector(F.array(F.lit(3.0), F.lit(-1.0)))).repartition(3)
    model = anomaly.CurvedReconstruction.fit(same, k=2, waves=8)
    assert model.score(same).agg(F.max("error")).first()[0] == pytest.approx(0, abs=1e-20)
    with pytest.raises(ValueError, match="two normal rows"):
        anomaly.CurvedReconstruction.fit(same.limit(1))
