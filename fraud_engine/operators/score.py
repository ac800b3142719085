"""Scoring with a stored model, and the flagged transactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import schema as S
from ..errors import ModelNotFound
from ..session import local_table
from ..sources import read_or_none
from .boosting import BoostedTrees


@dataclass(frozen=True)
class FraudModel:
    """Classifier and decision threshold."""

    trees: BoostedTrees
    threshold: float

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.trees.save(f"{path}/model")
        (local_table(spark, [(float(self.threshold),)], "threshold double")
         .write.mode("overwrite").parquet(f"{path}/threshold"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FraudModel":
        threshold = read_or_none(spark.read.parquet, f"{path}/threshold")
        if threshold is None or read_or_none(spark.read.parquet, f"{path}/model/nodes") is None:
            raise ModelNotFound(f"no stored classifier under {path}")
        return cls(BoostedTrees.load(spark, f"{path}/model"), threshold.first()["threshold"])

    def score(self, features: DataFrame) -> DataFrame:
        return apply_threshold(with_probability(self.trees, features), self.threshold)


def with_probability(trees: BoostedTrees, features: DataFrame) -> DataFrame:
    """`features` with the probability of fraud and the prediction at 0.5."""
    return trees.score(features).withColumn("prediction", fn.above_threshold("fraud_probability", 0.5))


def apply_threshold(scored: DataFrame, threshold: float, score: str = "fraud_probability") -> DataFrame:
    return scored.withColumn("is_fraud_predicted", fn.above_threshold(score, threshold))


def score_summary(scored: DataFrame, score: str = "fraud_probability",
                  prediction: str = "is_fraud_predicted") -> DataFrame:
    """Range of the score, number flagged, and the flagged share in percent."""
    return scored.agg(
        F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.coalesce(F.sum(prediction), F.lit(0)).cast("long").alias("flagged"),
        F.count("*").alias("total"),
    ).withColumn("flagged_pct", F.try_divide(F.col("flagged"), F.col("total")) * 100)


def flagged_transactions(scored: DataFrame, tie_break: str | None = None, ordered: bool = True) -> DataFrame:
    """Rows above the threshold with score, label, amount and hour, highest score first."""
    flagged = scored.where(F.col("is_fraud_predicted") == 1).withColumns({
        "is_fraud_actual": F.col(S.LABEL).cast("int"),
        "transaction_amount": F.col("amt"),
        "transaction_hour": F.col("txn_time"),
    }).drop(S.LABEL, "prediction")
    if not ordered:
        return flagged
    order = [F.desc("fraud_probability")] + ([F.col(tie_break)] if tie_break else [])
    return flagged.orderBy(*order)
