"""The pipeline's stages against plain versions, and the registered queries."""

import llm_brute as brute
import corpus_pipeline
import pytest

from fraud_engine.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def folder(spark, make, doubled, tmp_path):
    rows = doubled + [(9001, " ".join(f"b{i}" for i in range(4, 20)))]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(25)))], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def plain(rows):
    """(doc_id, text) after line dedup, and the rows that near-copy removal keeps."""
    cut = {(d, t): k for (d, t), (*_, k) in zip(rows, brute.deduped_lines(rows))}
    rows = [(d, None if t is None else cut[d, t]) for d, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0)
    distinct = sorted(set(rows), key=lambda r: (order(r), r[1] is not None, r[1] or ""))
    components = brute.link_components([(k, t) for k, (_, t) in enumerate(distinct)])
    # The least number of a component is a row of its smallest id.
    best = {}
    for k, (n, c) in components.items():
        best.setdefault(c if n else ("alone", k), []).append(distinct[k])
    return rows, best


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontaminate", "best_fit"]
    kept = corpus_pipeline.not_toxic(spark, docs, path)
    assert kept.columns == columns and kept.count() == len(rows)
    lines = corpus_pipeline.without_repeated_lines(spark, kept, path)
    expected, best = plain(rows)
    assert lines.columns == columns
    assert sorted(map(repr, [(r.doc_id, r.text) for r in lines.collect()])) == sorted(map(repr, expected))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())
    group = corpus_pipeline.one_of_each_group(spark, lines, path)
    assert group.columns == columns
    left = [(r.doc_id, r.text) for r in group.collect()]
    assert len(left) == len(set(left)) == len(best)
    smallest = lambda rows: min((d for d, _ in rows if d is not None), default=None)
    for members in best.values():
        own = [r for r in left if r in members]
        assert len(own) == 1 and own[0][0] == smallest(members)
    clean = corpus_pipeline.uncontaminated(spark, group, path)
    assert clean.columns == columns
    assert {r.doc_id for r in group.collect()} - {r.doc_id for r in clean.collect()} == {9001}
    pieces = corpus_pipeline.packed(spark, clean, path)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in clean.collect()}


CLASHING = ["kept", "_id", "_key", "_n", "_row", "_number", "_carried", "gone", "last_doc", "text_key", "score", "predicted", "n_hit", "items", "row_key", "component"]


def test_columns_of_clashing_names(spark, folder):
    """Every stage keeps columns that it uses the names of itself."""
    from pyspark.sql import functions as F

    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.lit(":"), F.col("doc_id")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        for r in docs.collect():
            assert r.doc_id is None or all(r[c] == f"{c}:{r.doc_id}" for c in CLASHING), name
    assert set(CLASHING) <= set(docs.columns)
    assert corpus_pipeline.packed(spark, docs, path).count() >= docs.count()


def test_groups_keep_the_smallest_id(spark, make, rows):
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, make(rows), "").collect()}
    assert got == {d for d, (_, c) in brute.link_components(rows).items() if c == d}


def test_toxic_documents_go(spark, make, rows, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    bad = {d for d, _ in rows[:7]}
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    real = toxicity.score_documents
    monkeypatch.setattr(toxicity, "score_documents", lambda docs, labels, carry: real(docs, labels, carry).withColumn(
        "predicted", F.col("doc_id").isin(list(bad)).cast("int")))
    kept = corpus_pipeline.not_toxic(spark, make(rows), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - bad


def test_run(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns[:2] == ["doc_id", "piece"] and 9001 not in {r.doc_id for r in got.collect()}


def test_all_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names
