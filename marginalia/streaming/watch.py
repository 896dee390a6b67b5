"""Micro-batches of changed files through the same pipeline."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from marginalia.plans.run import Options, run


def watch(sources: DataFrame, options: Options, out: str) -> DataStreamWriter:
    """A stream writer that checks every batch of ``(file, content)`` and writes its results.

    A batch's results replace what an earlier attempt at the same batch wrote, so a restarted
    query leaves each result once; the verdict cache keeps a repeated batch from being paid for
    again. The caller starts the writer with a checkpoint location. A batch that the budget stopped or
    whose scorer failed softly is not complete: it is not written, the query fails and a restart
    takes the batch up again.
    """
    def check(batch: DataFrame, batch_id: int) -> None:
        report = run(batch.sparkSession, replace(options, mode="check", sources=batch))
        if report.stopped is not None:
            raise report.stopped
        if report.results is None:
            raise RuntimeError(f"batch {batch_id} was not scored: {report.soft_failed}")
        report.results.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    return sources.writeStream.foreachBatch(check)
