import pytest

from raw_logs import RAW_COLUMNS, raw_row, write_csv
from fraud_engine import schema as S
from fraud_engine.sources.readers import file_headers, found_types, merged_types, read_inferred, read_rescued, unreadable_values
from fraud_engine.sources import (
    DatasetCatalog, LoadCache, output_name, read_features, read_flagged, read_job_matrix,
    read_or_none, read_report, read_transactions, write_flagged, write_table,
)


def test_raw_columns_are_read_by_name_with_types(raw):
    df = raw([raw_row(category="misc, net")], columns=RAW_COLUMNS[::-1])
    assert df.schema["cc_num"].dataType.simpleString() == "bigint"
    assert df.schema["amt"].dataType.simpleString() == "double"
    row = df.first()
    assert (row["category"], row["amt"], row["zip"]) == ("misc, net", 10.0, "01234")


def test_a_bad_value_becomes_null(raw):
    row = raw([raw_row(amt="ten", lat="")]).first()
    assert row["amt"] is None and row["lat"] is None


def test_missing_input_gives_none(spark, tmp_path):
    missing = str(tmp_path / "none.csv")
    assert read_or_none(read_transactions, spark, missing) is None
    assert read_or_none(read_report, spark, str(tmp_path / "none")) is None


def test_other_errors_stay_errors(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        read_or_none(read_features, spark, str(tmp_path / "x.parquet")).collect()


def test_catalog(spark, tmp_path):
    write_csv(tmp_path / "TransactionLogs-1.csv", [raw_row()])
    catalog = DatasetCatalog(str(tmp_path))
    assert catalog.read(spark, "TransactionLogs-1").count() == 1
    with pytest.raises(KeyError):
        catalog.path("TransactionLogs-9")


def test_cache_is_keyed_and_can_be_dropped(spark, tmp_path):
    cache = LoadCache(spark)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert cache.load(read_features, a) is None
    write_table(spark.range(3), a)
    write_table(spark.range(5), b)
    assert cache.load(read_features, a).count() == 3
    assert cache.load(read_features, b).count() == 5
    assert cache.load(read_features, a) is cache.load(read_features, a)
    cache.forget(a)
    write_table(spark.range(4), a)
    assert cache.load(read_features, a).count() == 4


def test_features_round_trip_through_csv(spark, tmp_path):
    schema = S.feature_schema()
    assert len(schema) == 93
    row = tuple(1.5 if f.dataType.simpleString() == "double" else 1 for f in schema)
    df = spark.createDataFrame([row], schema)
    path = write_table(df, str(tmp_path / "features.csv"), "csv")
    back = read_features(spark, path)
    assert back.schema == schema and back.collect() == df.collect()


def test_flagged_rows_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.9)], "trans_num int, fraud_probability double")
    path = write_flagged(df.repartition(3), str(tmp_path / "f.csv"), "csv")
    assert [r["trans_num"] for r in spark.read.option("header", True).csv(path).collect()] == ["2", "3", "1"]
    assert [r["fraud_probability"] for r in read_flagged(spark, path).collect()] == [0.9, 0.9, 0.2]


def test_files_of_a_folder_may_order_their_columns_differently(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a b.csv").write_text("cc_num,amt,category\n1,2.5,home\n")
    (tmp_path / "log/b.csv").write_text("amt,cc_num,category\n3.5,4,travel\nx,5,travel\n")
    (tmp_path / "log/c.csv").write_text("cc_num,category\n6,home\n")
    got = read_transactions(spark, str(tmp_path / "log"))
    assert sorted(map(tuple, got.select("cc_num", "amt", "category").collect())) == [
        (1, 2.5, "home"), (4, 3.5, "travel"), (5, None, "travel"), (6, None, "home")]
    assert {tuple(r) for r in unreadable_values(spark, str(tmp_path / "log")).collect()} == {
        ("cc_num", 0), ("amt", 1), ("category", 0)}


def test_job_matrix(spark, tmp_path):
    (tmp_path / "jobs.csv").write_text("A_&_B,C\nx,y\nz,\n")
    df = read_job_matrix(spark, str(tmp_path / "jobs.csv"))
    assert df.columns == ["A_&_B", "C"] and df.count() == 2


def test_output_name():
    assert output_name("/data/raw/TransactionLogs-1.csv") == "Processed_TransactionLogs-1.csv"
    assert output_name("/data/raw/log.csv/", "parquet") == "Processed_log.parquet"


def jvm_bytes(spark):
    """Bytes that the Java process has read so far, sockets included."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    with open(f"/proc/{pid}/io") as f:
        return int(f.readline().split()[1])


def test_headers_are_found_without_reading_the_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    body = "".join(f"{i},{i * 0.5},home\n" for i in range(400_000))
    for k, head in enumerate(["cc_num,amt,category", "amt,cc_num,category", "cc_num,amt,category"]):
        (tmp_path / f"log/{k}.csv").write_text(f"{head}\n{body}")
    (tmp_path / "log/empty.csv").write_text("")
    total = sum(p.stat().st_size for p in (tmp_path / "log").iterdir())
    file_headers(spark, str(tmp_path / "log"))  # code is loaded
    before = jvm_bytes(spark)
    found = file_headers(spark, str(tmp_path / "log"))
    read = jvm_bytes(spark) - before
    assert [h for h, _ in found] == [["amt", "cc_num", "category"], ["cc_num", "amt", "category"]]
    assert [[f.rsplit("/", 1)[1] for f in files] for _, files in found] == [["1.csv"], ["0.csv", "2.csv"]]
    assert read < total / 8, f"{read} of {total}"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "134217728b"


def test_headers_with_quotes_and_blank_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.csv").write_text('"cc_num","amt"\n1,2\n')
    (tmp_path / "log/b.csv").write_text("cc_num,amt\n3,4\n")
    assert len(file_headers(spark, str(tmp_path / "log"))) == 1
    assert sorted(read_transactions(spark, str(tmp_path / "log")).collect()) == [(1, 2.0), (3, 4.0)]


def test_types_are_found_and_merged(spark, tmp_path):
    head = "a,b,c,d,e,f,g,h\n"
    (tmp_path / "1.csv").write_text(head + "1,5000000000,1.5,2020-01-01,2020-01-01 10:00:00,true,x,\n2,1,2,2020-1-2,2020-01-01,FALSE,1,\n")
    (tmp_path / "2.csv").write_text("b,a,c,d,e,f,g,h\n1,2.5,NaN,soon,2021-01-01T00:00:00,true,2,\n")
    kinds = lambda df: {r["column"]: r["type"] for r in df.collect()}
    one, two = (found_types(spark, str(tmp_path / f"{k}.csv")) for k in (1, 2))
    assert kinds(one) == {"a": "int", "b": "bigint", "c": "double", "d": "date", "e": "timestamp", "f": "boolean", "g": "string", "h": "string"}
    both = kinds(merged_types(one, two))
    assert both == {"a": "double", "b": "bigint", "c": "double", "d": "string", "e": "timestamp", "f": "boolean", "g": "string", "h": "string"}
    (tmp_path / "both").mkdir()
    for k in (1, 2):
        (tmp_path / f"both/{k}.csv").write_text((tmp_path / f"{k}.csv").read_text())
    assert kinds(found_types(spark, str(tmp_path / "both"))) == both
    got = read_inferred(spark, str(tmp_path / "both"))
    assert dict(got.dtypes)["a"] == "double" and got.count() == 3 and got.where("b = 5000000000").count() == 1


def test_values_that_do_not_fit_are_kept(spark, tmp_path):
    path = write_csv(tmp_path / "log.csv", [raw_row(amt="ten", lat="north"), raw_row(trans_num="t2", amt=""), raw_row(trans_num="t3")])
    got = {r["trans_num"]: (r["amt"], r["_rescued"]) for r in read_rescued(spark, path).collect()}
    assert got == {"t1": (None, {"amt": "ten", "lat": "north"}), "t2": (None, None), "t3": (10.0, None)}
