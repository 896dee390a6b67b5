"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a temporary one only in local mode where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="marginalia-llm-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` as Parquet to the shared folder and read them again: lineage ends at files no executor owns."""
    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)
