"""Connected components as joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (u, v longs), component: the least node reachable.

    Each step hangs a node's neighbours on the least of them. A node's neighbours are aggregated, never
    collected, and the number of steps grows with the logarithm of the number of nodes.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "edges")
        new_mark = _mark(after)
        now = after
        if new_mark == mark:
            break
        mark = new_mark
    roots = now.select(F.col("v").alias("node")).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
