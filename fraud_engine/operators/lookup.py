"""The job lookup: wide matrix to pairs and back, and the join that uses it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table, materialize
from ..sources import write_table
from .joins import left_lookup
from .ranking import places_within

def matrix_to_pairs(wide: DataFrame) -> DataFrame:
    """One row (job_category, job) per filled cell, distinct."""
    cells = wide.unpivot([], [F.col(f"`{c}`") for c in wide.columns], "job_category", "job")
    return cells.where(F.col("job").isNotNull() & (F.col("job") != "")).distinct()


def pairs_to_matrix(pairs: DataFrame, categories: list[str], order_by: str = "job") -> DataFrame:
    """Row i holds the i-th job of every category, "" where a category has no more.

    A category of any size is ranked in slices. Pairs without category have no column.
    """
    known = materialize(pairs.where(F.col("job_category").isNotNull()), "matrix_pairs")
    placed = places_within(known, "job_category", order_by, known.count())
    return (
        placed.withColumn("position", F.col("before").cast("int"))
        .groupBy("position").pivot("job_category", categories).agg(F.first("job"))
        .na.fill("")
    )


def write_matrix(pairs: DataFrame, categories: list[str], path: str) -> str:
    """The wide matrix as CSV with a header, rows in order."""
    matrix = pairs_to_matrix(pairs, categories).orderBy("position").drop("position")
    return write_table(matrix, path, "csv")


@dataclass(frozen=True)
class JobLookup:
    """Checked (job, job_category) pairs: every job has one category."""

    pairs: DataFrame
    rows: int

    @classmethod
    def fit(cls, pairs: DataFrame) -> "JobLookup":
        pairs = pairs.select("job", "job_category")
        per_job = pairs.groupBy("job").agg(F.count("*").alias("n"))
        rows, worst = per_job.agg(F.count("*"), F.max("n")).first()
        if rows and worst > 1:
            raise ValueError("a job is listed in two categories; the join would repeat rows")
        return cls(pairs, rows)

    @classmethod
    def from_dict(cls, spark: SparkSession, jobs: dict[str, list[str]]) -> "JobLookup":
        rows = [(job, category) for category, names in jobs.items() for job in names]
        return cls.fit(local_table(spark, rows, "job string, job_category string"))

    def attach(self, txn: DataFrame) -> DataFrame:
        """`txn` with `job_category`, null for a job that is not listed."""
        return left_lookup(txn, self.pairs, "job")
