"""Cutting lineage on storage that outlives executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(rows: DataFrame) -> DataFrame:
    """Checkpoint into the folder ``spark.checkpoint.dir`` names; a temporary one only in local mode where none is set."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="marginalia-checkpoints-"))
    return rows.checkpoint(eager=True)
