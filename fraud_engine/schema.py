"""Column names, vocabularies and schemas."""

from __future__ import annotations

from pyspark.sql import types as T

LABEL = "is_fraud"
CARD = "cc_num"
ROW_KEY = "trans_num"

# Raw transaction columns that carry nothing for the models.
UNUSED = [
    "index", "merchant", "first", "last", "gender", "street", "city", "zip", "city_pop",
    "trans_num", "unix_time",
]

# The columns of a raw log, with the types that the engine works with. Timestamp and birth date stay text until the feature step
# parses them, so that a bad value turns into null there and not into a failed read.
RAW = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("trans_date_trans_time", T.StringType()),
    T.StructField("cc_num", T.LongType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("amt", T.DoubleType()),
    T.StructField("first", T.StringType()),
    T.StructField("last", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("street", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("zip", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
    T.StructField("city_pop", T.LongType()),
    T.StructField("job", T.StringType()),
    T.StructField("dob", T.StringType()),
    T.StructField("trans_num", T.StringType()),
    T.StructField("unix_time", T.LongType()),
    T.StructField("merch_lat", T.DoubleType()),
    T.StructField("merch_long", T.DoubleType()),
    T.StructField("is_fraud", T.IntegerType()),
])

# The published vocabularies of the feature table.
CATEGORIES = [
    "entertainment", "food_dining", "gas_transport", "grocery_net", "grocery_pos",
    "health_fitness", "home", "kids_pets", "misc_net", "misc_pos", "personal_care",
    "shopping_net", "shopping_pos", "travel",
]
STATES = [
    "AK", "AL", "AR", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA", "ID", "IL",
    "IN", "KS", "KY", "LA", "MA", "MD", "ME", "MI", "MN", "MO", "MS", "MT", "NC", "ND", "NE",
    "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT",
    "VA", "VT", "WA", "WI", "WV", "WY",
]
JOB_CATEGORIES = [
    "Business_&_Management", "Healthcare_&_Medical", "Creative_Arts_&_Media",
    "Engineering_&_Technology", "Education_&_Teaching", "Science_&_Research",
    "Legal_&_Government", "Finance_&_Accounting", "Construction_&_Surveying",
    "Environment_&_Agriculture", "Social_Services_&_Community",
    "Transportation_&_Entertainment_Services",
]
# Flag name and first year of each birth decade.
DECADES = {
    "dob_20s": 1920, "dob_30s": 1930, "dob_40s": 1940, "dob_50s": 1950, "dob_60s": 1960,
    "dob_70s": 1970, "dob_80s": 1980, "dob_90s": 1990, "dob_00s": 2000,
}

CATEGORY_PREFIX = "TXNctg_"
STATE_PREFIX = "state_"
JOB_PREFIX = "JOBctg_"
DECADE_PREFIX = "dob_"

CARD_METRICS = ["avg_txn_amt", "stddev_txn_amt", "avg_txn_time", "avg_merchant_distance"]


def category_columns(values: list[str]) -> list[str]:
    return [CATEGORY_PREFIX + v for v in values]


def state_columns(values: list[str]) -> list[str]:
    return [STATE_PREFIX + v for v in values]


def job_columns(values: list[str]) -> list[str]:
    return [JOB_PREFIX + v.replace(" ", "_") for v in values]


def feature_columns(categories=CATEGORIES, states=STATES, job_categories=JOB_CATEGORIES) -> list[str]:
    """The model's inputs in table order: 92 for the published vocabularies."""
    return [
        "txn_time", "amt",
        *category_columns(categories), *state_columns(states), *job_columns(job_categories),
        *DECADES, *CARD_METRICS,
    ]


_DOUBLES = {"amt", *CARD_METRICS}


def feature_schema(categories=CATEGORIES, states=STATES, job_categories=JOB_CATEGORIES) -> T.StructType:
    """The processed table: label first, then the features."""
    return T.StructType([
        T.StructField(c, T.DoubleType() if c in _DOUBLES else T.IntegerType())
        for c in [LABEL, *feature_columns(categories, states, job_categories)]
    ])


# The columns of this file format.
FLAGGED_EXTRA = T.StructType([
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("is_fraud_predicted", T.IntegerType()),
    T.StructField("is_fraud_actual", T.IntegerType()),
    T.StructField("transaction_amount", T.DoubleType()),
    T.StructField("transaction_hour", T.IntegerType()),
])

_COUNTS = T.MapType(T.StringType(), T.LongType())

# The columns of this file format.
REPORT = T.StructType([
    T.StructField("job_categories", _COUNTS),
    T.StructField("transaction_categories", _COUNTS),
    T.StructField("age_groups", _COUNTS),
    T.StructField("amount_analysis", T.StructType([
        T.StructField("fraud_avg", T.DoubleType()),
        T.StructField("normal_avg", T.DoubleType()),
        T.StructField("increase_pct", T.DoubleType()),
    ])),
    T.StructField("time_analysis", T.StructType([
        T.StructField("fraud_avg_hour", T.DoubleType()),
        T.StructField("normal_avg_hour", T.DoubleType()),
    ])),
    T.StructField("model_performance", T.StructType([
        T.StructField("fraud_detected", T.LongType()),
        T.StructField("total_transactions", T.LongType()),
        T.StructField("detection_rate", T.DoubleType()),
    ])),
])

# The columns of this file format.
EXPLANATION = T.StructType([
    T.StructField("transaction_id", T.IntegerType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("time", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("explanation", T.StringType()),
])

EXPLANATION_DOCUMENT = T.StructType([
    T.StructField("generated_at", T.StringType()),
    T.StructField("total_transactions", T.LongType()),
    T.StructField("explanations", T.ArrayType(EXPLANATION)),
])
