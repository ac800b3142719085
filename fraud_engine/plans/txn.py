"""Card transactions derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import fit_vocabulary
from ..operators.features import FeatureModel
from ..operators.lookup import JobLookup
from .. import schema as S
from ..session import tune

# Event types stand in for purchase categories; one has a comma.
CATEGORY_OF_EVENT = {
    "view": "gas_transport", "click": "shopping_net", "signup": "misc,net", "purchase": "grocery_pos",
}
OTHER_CATEGORY = "travel"
JOBS = ["Engineer, electronics", "Lawyer", "Surgeon", "Private music teacher", "Unlisted job"]
JOB_CATEGORY = {
    "Engineering_&_Technology": ["Engineer - electronics"],
    "Legal_&_Government": ["Lawyer"],
    "Healthcare_&_Medical": ["Surgeon"],
    "Education_&_Teaching": ["Private music teacher"],
}
CATEGORIES = ["gas_transport", "grocery_pos", "misc -net", "shopping_net", "travel"]


# The columns that are used, so that reading needs no look at the files first.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_name string, p_brand string, p_type string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions, customers as cards, nations as states, plus a stand-in `score`."""
    tune(spark)
    e, c, n = (table(spark, sf_dir, t) for t in ("events", "customer", "nation"))
    e = e.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int")).drop("props")
    joined = e.join(c, e.user_id == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    k = F.col("k")
    lat = F.lit(-40.0) + 3.0 * F.col("c_nationkey") + (F.col("c_custkey") % 17) / 10.0
    long = F.lit(-100.0) + 4.0 * F.col("c_nationkey") + (F.col("c_custkey") % 13) / 10.0
    category, job = F.lit(OTHER_CATEGORY), F.lit(None).cast("string")
    for event, name in CATEGORY_OF_EVENT.items():
        category = F.when(F.col("event_type") == event, name).otherwise(category)
    for i, name in enumerate(JOBS):
        job = F.when(k % 6 == i, name).otherwise(job)
    fraud = (k >= 97) | ((F.col("event_type") == "error") & (F.col("value") > 150.0))
    return joined.select(
        F.col("event_id").alias("trans_num"),
        F.col("ts").alias("trans_date_trans_time"),
        F.col("user_id").alias("cc_num"),
        category.alias("category"),
        F.col("value").alias("amt"),
        F.col("n_name").alias("state"),
        lat.alias("lat"),
        long.alias("long"),
        job.alias("job"),
        F.date_add(F.lit("1920-01-01").cast("date"), ((F.col("c_custkey") * 733) % 32000).cast("int")).alias("dob"),
        (lat + (k - 50) / 100.0).alias("merch_lat"),
        (long + (F.col("event_id") % 100 - 50) / 100.0).alias("merch_long"),
        F.when(fraud, 1).otherwise(0).alias("is_fraud"),
        F.least(F.lit(1.0), F.col("value") / 300.0).alias("score"),
    )


def job_lookup(spark: SparkSession) -> JobLookup:
    return JobLookup.from_dict(spark, JOB_CATEGORY)


def feature_model(spark: SparkSession, sf_dir: str) -> FeatureModel:
    """States come from the nation table, so the columns are the same at every scale."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("state"))
    return FeatureModel(
        CATEGORIES, fit_vocabulary(nations, ["state"])["state"], S.JOB_CATEGORIES, job_lookup(spark))


def features(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return feature_model(spark, sf_dir).transform(transactions(spark, sf_dir), keep=keep)


def raw_log(t: DataFrame) -> DataFrame:
    """Transactions with all columns of a raw log, as text files hold them."""
    made = {
        "index": F.col("trans_num"), "trans_date_trans_time": F.date_format("trans_date_trans_time", "yyyy-MM-dd HH:mm:ss"),
        "merchant": F.concat(F.lit("merchant, no "), F.col("cc_num") % 7), "first": F.lit("A"), "last": F.lit("B"),
        "gender": F.lit("F"), "street": F.lit("1 Street"), "city": F.lit("City"), "zip": F.lit("01234"),
        "city_pop": F.lit(1000), "unix_time": F.unix_timestamp(F.col("trans_date_trans_time").cast("timestamp")),
    }
    return t.withColumns(made).select(*S.RAW.names)
