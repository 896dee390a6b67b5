"""The Spark session the command line, tests and benchmarks use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: The largest method, in bytes of code, that HotSpot compiles.
COMPILED_METHOD_BYTES = 8000


def small_methods(spark: SparkSession) -> None:
    """Generated code stays within what the JVM compiles, unless the session asks for less.

    The rules of the languages make longer methods, which would be interpreted; beyond the limit Spark cuts them up.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > COMPILED_METHOD_BYTES:
        spark.conf.set(name, str(COMPILED_METHOD_BYTES))


#: Most bytes of rows that go to a Python process at once.
BATCH_BYTES = 1 << 21


def small_batches(spark: SparkSession) -> None:
    """What Python holds of a table at once is bounded by bytes, not by the rows of a partition, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def session(cores: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` only where none is configured."""
    builder = SparkSession.builder.appName("marginalia")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call sites of column expressions cost a third of the time plans take to build
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if cores or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cores or '*'}]")
        defaults |= {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
