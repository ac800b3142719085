"""The full run: features, scoring, flagged rows, report and explanations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..operators.explain import explain, write_explanations
from ..operators.features import FeatureModel
from ..operators.report import pattern_report, write_report
from ..operators.score import FraudModel, flagged_transactions
from ..session import materialize, tune
from ..sources import output_name, read_transactions, write_flagged, write_table


@dataclass(frozen=True)
class RunPaths:
    features: str
    flagged: str
    report: str
    explanations: str


def process_transactions(spark: SparkSession, input_path: str, model: FeatureModel,
                         out_dir: str, fmt: str = "parquet") -> str:
    """Raw log to stored feature table; the path of the table."""
    raw = read_transactions(spark, input_path)
    keep = (S.ROW_KEY,) if S.ROW_KEY in raw.columns else ()
    features = model.transform(raw, keep=keep, parse_once=True)
    return write_table(features, f"{out_dir}/{output_name(input_path, fmt)}", fmt)


def detect(features: DataFrame, model: FraudModel, out_dir: str, fmt: str = "parquet") -> tuple[str, str]:
    """Score features; write flagged rows and the report. Their paths.

    The scores are stored once, then both results read them.
    """
    scored = materialize(model.score(features), "scored")
    flagged = write_flagged(flagged_transactions(scored, ordered=False), f"{out_dir}/flagged", fmt)
    report = write_report(pattern_report(scored), f"{out_dir}/report")
    return flagged, report


def run(spark: SparkSession, input_path: str, model_dir: str, out_dir: str,
        explain_rows: int = 50, generator=None) -> RunPaths:
    """`model_dir` holds `features` (FeatureModel) and `classifier` (FraudModel)."""
    tune(spark)
    feature_model = FeatureModel.load(spark, f"{model_dir}/features")
    classifier = FraudModel.load(spark, f"{model_dir}/classifier")
    path = process_transactions(spark, input_path, feature_model, out_dir)
    flagged, report = detect(spark.read.parquet(path), classifier, out_dir)
    found = spark.read.parquet(flagged)
    keep = (S.ROW_KEY,) if S.ROW_KEY in found.columns else ()
    explanations = write_explanations(
        explain(found, explain_rows, None, generator, keep=keep, outcome=True), f"{out_dir}/explanations")
    return RunPaths(path, flagged, report, explanations)
