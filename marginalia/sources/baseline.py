"""Baselines: ids a code base has decided to live with."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.schemas import BASELINE_FILE

FILE_NAME = "baseline.json"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``(id, rule)`` of a baseline document, or of a directory of parquet entries."""
    if os.path.isdir(path) or not path.endswith(".json"):
        return spark.read.parquet(path).select("id", "rule")
    rows = spark.read.schema(BASELINE_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.explode("entries").alias("e")).select("e.id", "e.rule")


def baseline_entries(results: DataFrame) -> DataFrame:
    """What the policy acted on, by id; copies stay."""
    return results.where("action <> 'keep'").select("id", "rule").orderBy("id")


def write_baseline(results: DataFrame, path: str) -> None:
    """A ``.json`` path gets one document, streamed partition by partition; any other, parquet."""
    entries = baseline_entries(results)
    if not path.endswith(".json"):
        entries.write.mode("overwrite").parquet(path)
        return
    with open(path, "w", encoding="utf-8") as out:
        out.write('{\n  "version": 1,\n  "entries": ')
        first = True
        for row in entries.toLocalIterator():
            entry = json.dumps({"id": row["id"], "rule": row["rule"]}, indent=2).replace("\n", "\n    ")
            out.write(("[" if first else ",") + "\n    " + entry)
            first = False
        out.write("null\n}\n" if first else "\n  ]\n}\n")
