"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Settings that the wide and skewed plans need, in any session.
_PLAN_CONF = {
    # A join on the card number is often followed by a grouping on it. Without this, AQE
    # leaves a skewed join partition whole rather than add a shuffle after the split.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM compiles no method of more than 8000 bytes. A stage that ends in some ninety flags
    # is longer in one piece, and ran six times slower than with a method per operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
_SESSION_CONF = {
    **_PLAN_CONF,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Wide plans are built from many column calls; recording a call site for each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_local_scratch: dict[str, str] = {}
_marked: set[str] = set()


def build_session(app_name: str = "fraud-engine", master: str | None = None, **conf) -> SparkSession:
    """A session with the engine's settings; `conf` keys use `__` for `.`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Plan settings for a session that somebody else has built."""
    for key, value in _PLAN_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    `spark.checkpoint.dir` names it. A temporary folder stands in for it in local mode only,
    where driver and executors are one machine.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_scratch:
        _local_scratch[sc.applicationId] = tempfile.mkdtemp(prefix="fraud-engine-")
    return _local_scratch[sc.applicationId]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """MLlib cuts the lineage of boosting only when a checkpoint folder is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows from the driver as part of the plan, so no job is needed to read them."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrow = pa.table(
        [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], names=schema.names)
    return spark.createDataFrame(arrow, schema)


def in_fixed_parts(df: DataFrame, key: str, parts: int) -> DataFrame:
    """`df` dealt by a hash of `key` into `parts` partitions, each in order of the key.

    What depends on partitions (random draws, order of additions) then depends on `parts` alone, not
    on the input's files or the cluster.
    """
    return df.repartition(parts, key).sortWithinPartitions(key)


def run_folder(spark: SparkSession) -> str:
    """The folder of this application inside the shared one; it goes when the application ends."""
    path = f"{scratch_dir(spark)}/fraud_engine/{spark.sparkContext.applicationId}"
    if path not in _marked:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        _marked.add(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that `materialize` has written; results that read them are void then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Later steps then read a table with known size statistics, and a lost executor costs a
    re-read, not a recomputation. The table goes with the application, or by `clear_scratch`.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folders_in(spark: SparkSession, path: str, holding: str = "") -> list[str]:
    """The folders right under `path`, those that hold a file of the name `holding` if one is given; none without `path`."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    where = make(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    return [s.getPath().toString() for s in store.listStatus(where)
            if s.isDirectory() and (not holding or store.exists(make(s.getPath(), holding)))]
