"""The learned operators: held-out accuracy, odd rows, missing labels."""

import llm_brute as brute
import pytest

from fraud_engine.llm import language, toxicity

SMALL = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not __import__("os").path.exists(SMALL), reason="no test data")


@data
def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = language.op5_language(spark, SMALL).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and brute.crc(r.doc_id) % 3 == 1 for r in got)


def test_languages_of_odd_texts(spark, make, rows):
    docs = make(rows)
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for d, t in rows:
        letters = any(c.isalpha() for c in t or "")
        assert got[d].lang_pred == ("en" if letters else "und")


def test_languages_of_repeats_and_of_nothing(spark, make, doubled):
    docs = make(doubled)
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(doubled) and all(0 <= r.score <= 1 for r in got)
    nothing = make([])
    assert language.predict(nothing, language.fit(nothing)).collect() == []


def test_toxicity_of_an_empty_table(spark, make):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(make([]), labels).collect() == []


def test_terms_of_toxic_documents_have_no_cap(spark, make):
    """Words of toxic documents alone are in the lexicon, however many there are."""
    toxic = make([(k, " ".join(f"bad{'abcdefghij'[k % 10]}{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(400)) + " shared") for k in range(60)])
    clean = make([(k, "shared words of all") for k in range(60)])
    lexicon = toxicity.learn_lexicon(toxic, clean, 60, 60)
    assert "shared" not in lexicon and "words" not in lexicon
    whole = [t for t in lexicon if not t.endswith("*")]
    assert len(whole) == 4000 and min(lexicon.values()) >= __import__("math").log(toxicity.LEAST_RATIO)


def test_languages_without_labels(spark, make):
    docs = make([(1, "abc"), (2, None)]).withColumn("lang", __import__("pyspark.sql.functions").sql.functions.lit(None).cast("string"))
    got = language.predict(docs, language.fit(docs)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_ftrl_is_sparse_and_right():
    import numpy as np

    rnd = np.random.default_rng(0)
    data_rows = []
    for _ in range(300):
        label = int(rnd.integers(3))
        places = np.append(np.array([label, 10 + int(rnd.integers(50))]), language.DIMENSIONS)
        data_rows.append((places, np.ones(3), label))
    weights = language.follow_the_leader(data_rows, 3)
    assert np.count_nonzero(weights[100:-1]) == 0
    assert all((v @ weights[p]).argmax() == y for p, v, y in data_rows)


@data
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity.op2_toxicity(spark, SMALL).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.score for r in got if r.toxic]
    clean = [r.score for r in got if not r.toxic]
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert better >= 0.85
    assert all(r.predicted == (r.score >= 0.5) and brute.crc(r.doc_id) % 5 == 0 for r in got)


def test_toxicity_without_both_classes(spark, make, rows):
    docs = make(rows)
    for found in ([], [(rows[0][0], 3, 0)], [(None, 1, 1), (rows[0][0], 1, None)]):
        labels = spark.createDataFrame(found, "doc_id long, quality int, toxic int")
        got = toxicity.score_documents(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_toxicity_of_odd_rows(spark, make, doubled):
    labels = spark.createDataFrame(
        [(d, 1, int("x1" in (t or ""))) for d, t in doubled if d is not None], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(make(doubled), labels).collect()
    assert len(got) == len(doubled) and all(0 <= r.score <= 1 for r in got)


def test_second_person_near_a_lexicon_word():
    import pyarrow as pa

    weights = toxicity.Weights({"bad": 2.0, "awf*": 1.5})
    near, far, stem, none = toxicity._feature_rows(
        pa.array(["you are bad", "you " + "x " * 9 + "bad", "AWFUL!", None]), weights)
    assert near[4] > 0 and far[4] == 0 and far[0] > 0
    assert stem[3] == 1.5 and stem[5] == 1 and stem[6] > 0 and not none.any()
