"""Preparation of features, and training of the boosted-tree classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from . import boosting

# Features that may be null: unreadable times, cards with one row. The mean stands in.
NULLABLE = ["txn_time", "amt", *S.CARD_METRICS]


def preparation(features: list[str], output: str = "features") -> list:
    """Stages from feature columns to one standardised vector column."""
    holes = [c for c in features if c in NULLABLE]
    filled = {c: f"{c}_filled" for c in holes}
    fill = [Imputer(strategy="mean", inputCols=holes, outputCols=[filled[c] for c in holes])] if holes else []
    return [
        *fill,
        VectorAssembler(inputCols=[filled.get(c, c) for c in features], outputCol="raw_features"),
        StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol=output),
    ]


def fit_preparation(train: DataFrame, features: list[str]) -> PipelineModel:
    """Means and spreads from `train` alone. A column without any value has the mean 0."""
    holes = [c for c in features if c in NULLABLE]
    if holes:
        known = train.agg(*[F.count(F.col(c)).alias(c) for c in holes]).first()
        empty = [c for c in holes if not known[c]]
        train = train.fillna(0, empty) if empty else train
    return Pipeline(stages=preparation(features)).fit(train)


@dataclass(frozen=True)
class TrainedModel:
    trees: boosting.BoostedTrees
    features: list[str]
    rounds: int
    losses: list[float]


def fit_boosted_trees(
    train: DataFrame,
    validation: DataFrame | None,
    features: list[str],
    key: str = S.ROW_KEY,
    folder: str | None = None,
    **settings,
) -> TrainedModel:
    """Boosted trees with fraud rows weighted by the class ratio; `settings` are those of `boosting.Settings`.

    With a validation table fitting ends after `patience` rounds without a lower log loss there, and the model
    keeps the rounds up to the best. With `folder`, a fit that was broken off goes on from its last stored round.
    Trees split on the order of values, so features are not standardised, and missing values have a side of their own.
    """
    found = boosting.fit(train, validation, features, key, boosting.Settings(**settings), folder)
    return TrainedModel(found.model, list(features), found.rounds, found.losses)


def feature_importances(model: TrainedModel, top: int | None = None, kind: str = "gain") -> DataFrame:
    """(feature, importance), highest first: mean gain of a feature's splits as a share of all features' sum."""
    table = model.trees.importances(SparkSession.active(), kind).orderBy(F.desc("importance"), "feature")
    return table if top is None else table.limit(top)
