"""Train, tune and evaluate: split, fit with early stopping, sweep on validation, test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import schema as S
from ..operators import metrics
from ..operators.score import FraudModel, apply_threshold, with_probability
from ..operators.split import THREE_WAY, TWO_WAY, exact_split, hash_split
from ..operators.train import TrainedModel, fit_boosted_trees
from ..session import materialize


@dataclass(frozen=True)
class TrainingResult:
    trained: TrainedModel
    model: FraudModel
    scores: DataFrame
    sweep: DataFrame

    def _test(self) -> DataFrame:
        return self.scores.where("split = 'test'")

    def default_confusion(self) -> DataFrame:
        return metrics.confusion(self._test())

    def default_report(self) -> DataFrame:
        return metrics.class_report(self._test())

    def tuned_confusion(self) -> DataFrame:
        return metrics.confusion(self._tuned(), prediction="is_fraud_predicted")

    def tuned_report(self) -> DataFrame:
        return metrics.class_report(self._tuned(), prediction="is_fraud_predicted")

    def comparison(self) -> DataFrame:
        return metrics.compare_thresholds(
            self._test(), self.model.threshold, score="fraud_probability")

    def _tuned(self) -> DataFrame:
        return apply_threshold(self._test(), self.model.threshold)


def _split(features: DataFrame, parts: dict, key: str, exact: bool) -> DataFrame:
    """The hash split is a function of the key, so only the exact one is worth storing."""
    if exact:
        return materialize(exact_split(features, parts, key=key), "split_features")
    return hash_split(features, parts, key=key)


def _scores(trained: TrainedModel, split: DataFrame, key: str) -> DataFrame:
    """Label, split and score only: every evaluation reads this narrow table."""
    scored = with_probability(trained.trees, split)
    return materialize(scored.select(
        key, "split", S.LABEL, "fraud_probability", "prediction"), "scores")


def train_and_tune(features: DataFrame, inputs: list[str], key: str = S.ROW_KEY,
                   exact: bool = False, thresholds: list[float] = metrics.THRESHOLDS,
                   **settings) -> TrainingResult:
    """60/20/20: rounds and threshold are chosen on validation, test is held out."""
    split = _split(features, THREE_WAY, key, exact)
    trained = fit_boosted_trees(
        split.where("split = 'train'"), split.where("split = 'validation'"), inputs, key=key, **settings)
    scores = _scores(trained, split, key)
    sweep = metrics.threshold_sweep(
        scores.where("split = 'validation'"), thresholds, score="fraud_probability")
    threshold = metrics.best_threshold(sweep).first()["threshold"]
    return TrainingResult(trained, FraudModel(trained.trees, threshold), scores, sweep)


def train_two_way(features: DataFrame, inputs: list[str], key: str = S.ROW_KEY,
                  exact: bool = False, **settings) -> TrainingResult:
    """70/30, the earlier protocol: the test part also stops the training; threshold 0.5."""
    split = _split(features, TWO_WAY, key, exact)
    trained = fit_boosted_trees(
        split.where("split = 'train'"), split.where("split = 'test'"), inputs, key=key, **settings)
    scores = _scores(trained, split, key)
    sweep = metrics.recall_at(scores.where("split = 'test'"), score="fraud_probability")
    return TrainingResult(trained, FraudModel(trained.trees, 0.5), scores, sweep)
