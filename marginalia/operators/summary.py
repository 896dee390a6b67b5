"""Aggregates over results and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.scoring import severity_rank


def reportable(results: DataFrame) -> DataFrame:
    """What the policy acted on."""
    return results.where("action <> 'keep'")


def report_order(results: DataFrame) -> DataFrame:
    """By file and line, then input order, as sorting is not stable (O2)."""
    return results.orderBy("file", "line", "ord")


def summary(results: DataFrame) -> DataFrame:
    """Severities and deletions over all results, zeros included, and the worst rank (A3, A4)."""
    return results.agg(
        *[F.count_if(F.col("severity") == name).alias(name) for name in ("error", "warning", "info")],
        F.count_if(F.col("action") == "delete").alias("deleted"),
        F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0)).alias("worst"))
