"""The corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, tokens.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its rows are written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontamination, language_id, line_dedup, near_dedup, token_codec
from marginalia.llm.queries import fold, table
from marginalia.llm.storage import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language (no text, or no letter in it); a missing ``lang`` becomes the predicted one.

    A low score alone is no reason to drop a document: short or mixed texts are clean as well. Where no
    document has a language to learn from, only those without a letter go.
    """
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    judged = language_id.predict(docs.select(*COLUMNS), model)
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    kept = judged.where(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that many documents share, but for the last document with each; update ``n_chars``."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    edited = F.col("n_dropped") > 0
    kept = kept.withColumn("text", F.when(edited, F.col("kept_text")).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(edited, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one of least id."""
    classes = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    gone = classes.where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark, literally or with other slot values."""
    judged = decontamination.judge(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return judged.where(F.size("items") == 0).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining texts, checked by decoding."""
    return token_codec.encode(docs.select("doc_id", "text"), keep_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("token_codec", encode_tokens),
]

#: Context trees, shingle components and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
