"""Which findings are worth scoring: one disposition per finding, counted in one pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import comment_text
from marginalia.operators.lookup import spread_join


def exempt_prefix(text: Column, prefixes) -> Column:
    """The prose is empty or starts with a prefix, whatever the case (F2)."""
    # one pattern, so the text is computed once wherever the optimizer moves the test to
    pattern = "|".join([r"\z", *(re.escape(prefix.lower()) for prefix in prefixes)])
    return F.lower(text).rlike(f"^(?:{pattern})")


def disposition(settings, kind: Column, text: Column, comment: Column, ignore_next: Column, baselined: Column) -> Column:
    """exempt, suppressed, baselined or kept; the first that applies counts."""
    return (
        F.when(~kind.isin(*settings.kinds), "exempt")
        .when(exempt_prefix(text, settings.all_exempt_prefixes), "exempt")
        .when((kind != "annotation") & (F.char_length(text) < settings.min_chars), "exempt")
        .when(F.contains(comment, F.lit(settings.ignore_marker)), "suppressed")
        .when(ignore_next, "suppressed")
        .when(baselined, "baselined")
        .otherwise("kept")
    )


def with_disposition(findings: DataFrame, settings, baseline: DataFrame | None = None) -> DataFrame:
    """Adds ``disposition`` to findings; ``baseline`` is any frame with an ``id`` column."""
    if baseline is None:
        marked = findings.withColumn("_known", F.lit(False))
    else:
        known = baseline.select("id").distinct().withColumn("_known", F.lit(True))
        marked = spread_join(findings, known, "id", ("file", "ord"))
    return marked.withColumn("_text", comment_text(F.col("comment_text"))).withColumn("disposition", disposition(
        settings, F.col("kind"), F.col("_text"), F.col("comment_text"), F.col("ignore_next"),
        F.coalesce("_known", F.lit(False)))).drop("_text", "_known")


def filter_counts(rows: DataFrame) -> DataFrame:
    """Exempt, suppressed and baselined counts (A1)."""
    return rows.agg(*[F.count_if(F.col("disposition") == name).alias(name)
                      for name in ("exempt", "suppressed", "baselined", "kept")])
