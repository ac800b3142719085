"""Readers for raw transactions, the job matrix, features and results."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the known columns by name; a value that does not fit becomes null."""
    types = {f.name: f.dataType for f in schema.fields}
    return df.select(*[
        F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
        for c in df.columns
    ])


def _is_parquet(path: str, fmt: str | None) -> bool:
    return fmt == "parquet" or (fmt is None and not path.rstrip("/").endswith(".csv"))


# Files whose headers are read at once.
_OPEN_FILES = 16


def _first_record(lines: Iterator[str]) -> list[str]:
    """The first record of CSV lines; a quoted name may go over several lines."""
    return next((r for r in csv.reader(line + "\n" for line in lines) if r), [])


def file_headers(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(header, files) of each distinct header of the CSV files under `path`; empty files have none.

    A file is opened through its file system and closed behind its header, so about a buffer of it is read. A task could
    not do that: Spark reads a file to its end for a Python task that has stopped.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def header(file: str) -> tuple[str, list[str]]:
        where = jvm.org.apache.hadoop.fs.Path(unquote(file))
        stream, codec = where.getFileSystem(conf).open(where), codecs.getCodec(where)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            return where.toString(), _first_record(line.removeprefix("\ufeff") for line in iter(reader.readLine, None))
        finally:
            reader.close()

    files: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(_OPEN_FILES) as pool:
        for file, names in pool.map(header, spark.read.text(path).inputFiles()):
            if names:
                files.setdefault(tuple(names), []).append(file)
    return sorted((list(names), sorted(own)) for names, own in files.items())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text, by name.

    Spark takes the first header it meets for all files of a folder. Here files are grouped by their
    header, each group is read with its own and the groups are united by name; a column
    that a file lacks is null there. There is one group in the common case. Building the plan reads the
    first bytes of each file.
    """
    plain = spark.read.option("header", True).option("multiLine", False)
    if len(plain.csv(path).inputFiles()) < 2:
        return plain.csv(path)
    groups = file_headers(spark, path)
    if len(groups) < 2:
        return plain.csv(path)
    tables = [plain.csv(files) for _, files in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


# Types a column of text may have, narrowest first; a column has the first one that all its values fit.
_LATTICE = ("int", "bigint", "double", "date", "timestamp", "boolean")
_WHOLE, _DAY = r"^[+-]?[0-9]+$", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def _fits(column: str, kind: str) -> Column:
    c = F.col(f"`{column}`")
    fits = c.try_cast(kind).isNotNull()
    if kind in ("int", "bigint"):
        return c.rlike(_WHOLE) & fits
    if kind == "double":
        return c.rlike(r"[0-9]") & ~c.rlike("[dDfF]$") & fits | c.isin("NaN", "Infinity", "-Infinity")
    if kind == "boolean":
        return F.lower(c).isin("true", "false")
    return (c.rlike(_DAY) if kind == "date" else c.rlike(r"^[0-9]{4}-")) & fits


def found_types(spark: SparkSession, path: str) -> DataFrame:
    """(column, n, n_int, n_bigint, n_double, n_date, n_timestamp, n_boolean, type) of a CSV, from one job over all values.

    `n` counts the values of a column that are there, `n_<type>` those that fit the type; `type` is the narrowest
    one that all of them fit, else string. The counts of files and folders add up, so types of several logs
    can be merged by adding their counts.
    """
    raw = read_csv(spark, path)
    counted = raw.agg(*[
        F.struct(F.count(F.col(f"`{c}`")).alias("n"), *[F.count_if(_fits(c, k)).alias(f"n_{k}") for k in _LATTICE]).alias(c)
        for c in raw.columns])
    rows = counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`")[f].alias(f) for f in ("n", *(f"n_{k}" for k in _LATTICE))])
        for c in raw.columns])))
    return rows.withColumn("type", narrowest())


def narrowest() -> Column:
    """The type that the counts of a row of `found_types` allow."""
    kind = F.lit("string")
    for k in reversed(_LATTICE):
        kind = F.when((F.col("n") > 0) & (F.col(f"n_{k}") == F.col("n")), k).otherwise(kind)
    return kind


def merged_types(*found: DataFrame) -> DataFrame:
    """The types of several logs together."""
    counts = ["n", *(f"n_{k}" for k in _LATTICE)]
    rows = reduce(lambda a, b: a.unionByName(b), found)
    return rows.groupBy("column").agg(*[F.sum(c).alias(c) for c in counts]).withColumn("type", narrowest())


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and the types that its values have, found in one pass over all of them."""
    kinds = {r["column"]: r["type"] for r in found_types(spark, path).select("column", "type").collect()}
    raw = read_csv(spark, path)
    return raw.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in raw.columns])


RESCUED = "_rescued"


def read_rescued(spark: SparkSession, path: str, schema: T.StructType = S.RAW) -> DataFrame:
    """As `read_transactions`, with the values that do not fit their column kept: `_rescued` maps column to text, or is null."""
    raw = read_csv(spark, path)
    kinds = {f.name: f.dataType for f in schema.fields if f.name in raw.columns}
    misfits = F.filter(
        F.array(*[
            F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull(), F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")))
            for c, t in kinds.items()]), lambda v: v.isNotNull())
    kept = raw.withColumn(RESCUED, F.when(F.size(misfits) > 0, F.map_from_entries(misfits)))
    return _typed(kept, schema)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Raw transactions from CSV with a header.

    Columns are taken by header name in any order, in every file. Only headers are read ahead; there
    is no inference pass over the data. `unreadable_values` counts what does not fit its column,
    `read_rescued` keeps it, `read_inferred` takes the types from the values.
    """
    return _typed(read_csv(spark, path), S.RAW)


def unreadable_values(spark: SparkSession, path: str, schema: T.StructType = S.RAW) -> DataFrame:
    """(column, n): values of a CSV that are there but become null because they do not fit."""
    raw = read_csv(spark, path)
    kinds = {f.name: f.dataType for f in schema.fields if f.name in raw.columns}
    counts = raw.agg(*[
        F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(c) for c, t in kinds.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in kinds])))


def read_job_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The wide job lookup: one column per category, blanks as padding."""
    return read_csv(spark, path)


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  fmt: str | None = None) -> DataFrame:
    """The processed feature table, from Parquet or CSV."""
    if _is_parquet(path, fmt):
        return spark.read.parquet(path)
    return _typed(read_csv(spark, path), schema or S.feature_schema())


def read_flagged(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 fmt: str | None = None) -> DataFrame:
    """Flagged transactions, from Parquet or CSV."""
    if _is_parquet(path, fmt):
        return spark.read.parquet(path)
    base = schema or S.feature_schema()
    return _typed(
        read_csv(spark, path),
        T.StructType([*base.fields, *S.FLAGGED_EXTRA.fields]),
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.REPORT).json(path, multiLine=True)


def read_explanations(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an explanation document, as `write_explanations` writes it in parts."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("row")).where(F.col("row").rlike(r'^\{"transaction_id"'))
    return lines.select(F.from_json("row", S.EXPLANATION).alias("r")).select("r.*")


def read_explanation_head(spark: SparkSession, path: str) -> DataFrame:
    """generated_at and total_transactions of an explanation document."""
    lines = spark.read.text(path).where(F.col("value").startswith('{"generated_at"'))
    whole = F.concat("value", F.lit("]}"))
    return lines.select(F.from_json(whole, S.EXPLANATION_DOCUMENT).alias("d")).select("d.generated_at", "d.total_transactions")


def read_or_none(reader: Callable[..., DataFrame], *args, **kwargs) -> DataFrame | None:
    """The reader's table, or None when its input does not exist. Other errors stay errors."""
    try:
        return reader(*args, **kwargs)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class DatasetCatalog:
    """Named transaction logs under one folder."""

    # The names offered for a run.
    DEFAULT = ("TransactionLogs-1", "TransactionLogs-2", "TransactionLogs-3")

    def __init__(self, root: str, names: tuple[str, ...] | None = None):
        self.root = root.rstrip("/")
        self.names = tuple(names or self.DEFAULT)

    def path(self, name: str) -> str:
        if name not in self.names:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(self.names)}")
        return f"{self.root}/{name}.csv"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return read_transactions(spark, self.path(name))


class LoadCache:
    """Cached result tables, keyed by reader and path, dropped on `forget`."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._tables: dict[tuple[str, str], DataFrame] = {}

    def load(self, reader: Callable[..., DataFrame], path: str) -> DataFrame | None:
        key = (reader.__name__, path)
        if key not in self._tables:
            df = read_or_none(reader, self._spark, path)
            if df is None:
                return None
            self._tables[key] = df.cache()
        return self._tables[key]

    def forget(self, path: str) -> None:
        """Call after `path` was written again."""
        for key in [k for k in self._tables if k[1] == path]:
            self._tables.pop(key).unpersist()
