"""Plain-language explanations of flagged transactions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import schema as S

# Readable names of the features.
FEATURE_NAMES = {
    "TXNctg_gas_transport": "Gas/Transport",
    "TXNctg_grocery_pos": "Grocery Store Purchase",
    "TXNctg_shopping_net": "Online Shopping",
    "TXNctg_food_dining": "Food/Dining",
    "TXNctg_entertainment": "Entertainment",
    "TXNctg_travel": "Travel",
    "TXNctg_misc_net": "Online Miscellaneous",
    "TXNctg_kids_pets": "Kids/Pets",
    "TXNctg_grocery_net": "Online Grocery",
    "TXNctg_personal_care": "Personal Care",
    "TXNctg_health_fitness": "Health/Fitness",
    "TXNctg_home": "Home Goods",
    "TXNctg_misc_pos": "In-Store Miscellaneous",
    "TXNctg_shopping_pos": "In-Store Shopping",
    "JOBctg_Business_&_Management": "Business/Management",
    "JOBctg_Healthcare_&_Medical": "Healthcare/Medical",
    "JOBctg_Creative_Arts_&_Media": "Creative Arts/Media",
    "JOBctg_Engineering_&_Technology": "Engineering/Technology",
    "JOBctg_Education_&_Teaching": "Education/Teaching",
    "JOBctg_Science_&_Research": "Science/Research",
    "JOBctg_Legal_&_Government": "Legal/Government",
    "JOBctg_Finance_&_Accounting": "Finance/Accounting",
    "JOBctg_Social_Services_&_Community": "Social Services",
    "JOBctg_Construction_&_Surveying": "Construction/Surveying",
    "JOBctg_Environment_&_Agriculture": "Environment/Agriculture",
    "JOBctg_Transportation_&_Entertainment_Services": "Transportation/Entertainment",
    "txn_time": "Transaction Time",
    "avg_txn_time": "User's Typical Transaction Time",
    "amt": "Transaction Amount",
    "avg_txn_amt": "User's Average Transaction Amount",
    "stddev_txn_amt": "Amount Variability",
    "avg_merchant_distance": "Distance from User's Typical Location",
}

UNKNOWN_CATEGORY = "Unknown Category"
UNKNOWN_JOB = "Unknown Profession"
UNKNOWN_AGE = "unknown age group"

# The texts that are filled in per row.
PROMPT = """Transaction Details:
- Amount: $%s (user's average: $%s)
- Time: %s (user's typical: %s)
- Category: %s
- User Profile: %s professional, %s
- Fraud Confidence: %s%%

Key Anomalies:
- Amount is %s higher than user's typical spending
- Time difference shows %s deviation from normal patterns

Explain why this transaction was flagged as fraudulent:"""
FALLBACK = (
    "This $%s transaction was flagged due to unusual patterns: amount is %s higher than "
    "typical spending and occurred at an unusual time (%s vs user's normal %s)."
)
SUMMARY = "Amount: $%s | Time: %s | Category: %s | Confidence: %s%%"

def feature_name(column: str, prefix: str = "") -> str:
    """Readable name, or the column name without its prefix when there is none."""
    return FEATURE_NAMES.get(column, column.removeprefix(prefix))


def active_flag(df: DataFrame, prefix: str, default: str, text: Callable[[str], str]) -> Column:
    """Text of the first one-hot column with this prefix that is 1."""
    flags = [F.when(F.col(f"`{c}`") == 1, F.lit(text(c))) for c in df.columns if c.startswith(prefix)]
    return F.coalesce(*flags, F.lit(default))


def first_present(df: DataFrame, names: list[str], default) -> Column:
    """First of these columns that the table has and that is not null, else the default."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(default))


def explanation_context(flagged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What an explanation says about a row, with the prompt and the templated text."""
    known = flagged.select(
        *keep,
        first_present(flagged, ["amt", "transaction_amount"], 0).cast("double").alias("amount"),
        first_present(flagged, ["txn_time", "transaction_hour"], 12).cast("int").alias("time"),
        active_flag(flagged, S.CATEGORY_PREFIX, UNKNOWN_CATEGORY,
                    lambda c: feature_name(c, S.CATEGORY_PREFIX)).alias("category"),
        active_flag(flagged, S.JOB_PREFIX, UNKNOWN_JOB,
                    lambda c: feature_name(c, S.JOB_PREFIX)).alias("job"),
        active_flag(flagged, S.DECADE_PREFIX, UNKNOWN_AGE,
                    lambda c: fn.decade_text(S.DECADES[c])).alias("age_group"),
        first_present(flagged, ["avg_txn_amt"], 0).cast("double").alias("user_avg_amount"),
        first_present(flagged, ["avg_txn_time"], 12).cast("double").alias("user_avg_time"),
        first_present(flagged, ["avg_merchant_distance"], 0).cast("double").alias("user_avg_distance"),
        first_present(flagged, ["fraud_probability"], 0).cast("double").alias("fraud_probability"),
    ).withColumn("amount_ratio", fn.amount_ratio("amount", "user_avg_amount"))
    judged = known.withColumns({
        "amount_anomaly": fn.anomaly_text("amount_ratio"),
        "time_anomaly": fn.hour_gap_bucket("time", "user_avg_time"),
        "time_text": fn.clock_text("time"),
        "usual_time_text": fn.clock_text("user_avg_time"),
    })
    amount, average = fn.fixed_text("amount", 2), fn.fixed_text("user_avg_amount", 2)
    confidence = fn.fixed_text(F.col("fraud_probability") * 100, 1)
    return judged.withColumns({
        "prompt": F.format_string(
            PROMPT, amount, average, "time_text", "usual_time_text", "category", "job",
            "age_group", confidence, "amount_anomaly", "time_anomaly"),
        "fallback": F.format_string(
            FALLBACK, amount, "amount_anomaly", "time_text", "usual_time_text"),
        "summary": F.format_string(SUMMARY, amount, "time_text", "category", confidence),
    })


def top_flagged(flagged: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first `n` rows in this order with their 0-based position as `transaction_id`."""
    top = flagged.orderBy(*order).limit(n)
    # The window sees the n rows only.
    return top.withColumn("transaction_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def _generate(context: DataFrame, generator: Callable[[str], str], tasks: int) -> DataFrame:
    """`context` with `generated` and, where the generator failed, `error` instead."""

    def call(prompt: str) -> tuple[str | None, str | None]:
        try:
            return generator(prompt), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes = [call(p) for p in batch["prompt"]]
            yield batch.assign(generated=[o[0] for o in outcomes], error=[o[1] for o in outcomes])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in context.schema.fields)
    return context.repartition(tasks).mapInPandas(run, f"{schema}, generated string, error string")


def explain(
    flagged: DataFrame,
    n: int = 50,
    order: list[Column | str] | None = None,
    generator: Callable[[str], str] | None = None,
    tasks: int = 8,
    keep: tuple[str, ...] = (),
    outcome: bool = False,
) -> DataFrame:
    """One explanation per row for the first `n` flagged rows, with the `keep` columns behind it.

    The text comes from `generator(prompt)`, a function of the caller, run in `tasks` tasks;
    without one, or where it fails, the templated text stands in. With `outcome` there are two more
    columns: `source` ("generator" or "template") and the generator's `error`. Rows of equal score are
    in order of their key, or of a hash of all columns where the table has none.
    """
    tie = F.col(S.ROW_KEY) if S.ROW_KEY in flagged.columns else F.xxhash64(*[F.col(f"`{c}`") for c in flagged.columns])
    top = top_flagged(flagged, n, order or [F.desc("fraud_probability"), tie])
    context = explanation_context(top, keep=("transaction_id", *keep))
    text, source, error = F.col("fallback"), F.lit("template"), F.lit(None).cast("string")
    if generator is not None:
        context = _generate(context, generator, tasks)
        cleaned = fn.clean_response("generated")
        source, error = F.when(cleaned.isNotNull(), "generator").otherwise("template"), F.col("error")
        text = F.coalesce(cleaned, text)
    return context.select(
        "transaction_id", "amount", "time", "category", "fraud_probability",
        text.alias("explanation"), *keep,
        *([source.alias("source"), error.alias("error")] if outcome else []))


def explanation_document(explanations: DataFrame) -> DataFrame:
    """Lines (`place`, `line`) that make one JSON document in order of `place`: head, a line for each row, end.

    The head has the time of writing and the number of rows; the rows are in order of `transaction_id`, which is
    unique. No line holds more than one row, so a document may have any number of them.
    """
    counted = explanations.agg(F.count("*").alias("n"), F.min("transaction_id").alias("first"))
    head = counted.select(
        F.lit(-2).cast("long").alias("place"),
        F.format_string('{"generated_at":"%s","total_transactions":%d,"explanations":[',
                        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "n").alias("line"))
    end = head.select(F.lit(2**62).alias("place"), F.lit("]}").alias("line"))
    least = counted.select("first")
    row = F.to_json(F.struct(*explanations.columns), {"ignoreNullFields": "false"})
    # A line break inside a text is written as \\n by JSON, so a row is one line.
    rows = explanations.crossJoin(F.broadcast(least)).select(
        F.col("transaction_id").cast("long").alias("place"),
        F.concat(F.when(F.col("transaction_id") > F.col("first"), ",").otherwise(""), row).alias("line"))
    return head.unionByName(rows).unionByName(end)


def write_explanations(explanations: DataFrame, path: str) -> str:
    """Flat rows under `rows`; under `document` the parts of one JSON document, whole in order of their names."""
    explanations.write.mode("overwrite").parquet(f"{path}/rows")
    stored = explanations.sparkSession.read.schema(explanations.schema).parquet(f"{path}/rows")
    explanation_document(stored).orderBy("place").select("line").write.mode("overwrite").text(f"{path}/document")
    return path
