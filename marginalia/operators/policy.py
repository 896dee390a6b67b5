"""The policy: percentages and flags to an action, a severity and a rule, as one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.paths import language_of

DECISION = "struct<action:string,severity:string,rule:string>"


def _decide(action: str, severity: str = "", rule: str = "") -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))


def keeps(settings, file: Column) -> Column:
    """The setting that shields a protected comment, which differs for Python."""
    return F.when(language_of(file) == "python", F.lit(settings.keep_docstrings)).otherwise(
        F.lit(settings.keep_exported_docs))


def decision(settings, *, file: Column, kind: Column, protected: Column, required: Column, accuracy_pct: Column,
             accuracy_confidence: Column, usefulness_pct: Column, usefulness_confidence: Column, overreach: Column,
             commented_out: Column) -> Column:
    """Action, severity and rule of one verdict; the first branch that holds decides."""
    shielded = required | (protected & keeps(settings, file))
    deciding = F.when(accuracy_pct <= usefulness_pct, accuracy_confidence).otherwise(usefulness_confidence)
    disabled = commented_out >= F.lit(C.COMMENTED_OUT_GUARD)
    useless = usefulness_pct <= settings.usefulness_delete
    annotated = "delete" if settings.delete_annotations else "flag"
    return (
        F.when(disabled & F.lit(settings.commented_out_code != "delete"), _decide("keep"))
        .when(disabled & shielded, _decide("flag", "warning", "commented-out-code"))
        .when(disabled, _decide("delete", "warning", "commented-out-code"))
        .when(deciding < F.lit(float(settings.min_confidence)), _decide("flag", "info", "low-confidence"))
        .when((kind != "doc") & (overreach >= F.lit(C.OVERREACH_GUARD)), _decide("flag", "info", "wide-scope"))
        .when(accuracy_pct <= settings.accuracy_error, _decide("flag", "error", "wrong-comment"))
        .when(useless & (kind == "annotation"), _decide(annotated, "warning", "redundant-annotation"))
        .when(useless & shielded, _decide("flag", "warning", "weak-comment"))
        .when(useless, _decide("delete", "warning", "useless-comment"))
        .when((accuracy_pct <= settings.accuracy_warning) | (usefulness_pct <= settings.usefulness_warning),
              _decide("flag", "warning", "weak-comment"))
        .otherwise(_decide("keep"))
    )


def classify(scored: DataFrame, settings) -> DataFrame:
    """Findings with a ``verdict`` struct to results with ``action``, ``severity`` and ``rule``."""
    v = F.col("verdict")
    made = decision(
        settings, file=F.col("file"), kind=F.col("kind"), protected=F.col("protected"), required=F.col("required"),
        accuracy_pct=v["accuracy"]["pct"], accuracy_confidence=v["accuracy"]["confidence"],
        usefulness_pct=v["usefulness"]["pct"], usefulness_confidence=v["usefulness"]["confidence"],
        overreach=v["overreach"]["prob"], commented_out=v["commented_out"]["prob"])
    return scored.withColumn("_d", made).select("*", "_d.action", "_d.severity", "_d.rule").drop("_d")
