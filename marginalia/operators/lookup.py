"""Lookups by key that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with this many rows on the left is split over FANOUT tasks; at most MAX_HOT keys are.
# Colder keys take the plain shuffle, so nothing depends on the numbers but speed.
HOT_ROWS = 1_000_000
MAX_HOT = 10_000
FANOUT = 64


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """The at most ``max_hot`` most frequent keys with ``hot_rows`` rows or more.

    Counting combines on the map side and the top-k is bounded, so the result is always small
    enough to broadcast.
    """
    counts = rows.groupBy(key).count().where(F.col("count") >= hot_rows)
    return counts.orderBy(F.desc("count"), key).limit(max_hot).select(key)


def spread_join(left: DataFrame, right: DataFrame, key: str, spread_by, how: str = "left", *,
                hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT, fanout: int = FANOUT) -> DataFrame:
    """Joins ``left`` with ``right``, which holds each key once, salting only the hot keys.

    Rows of a hot key are dealt over ``fanout`` salts by the ``spread_by`` columns and its one
    right row is copied to every salt; all other keys keep salt 0. When the right side is small
    by Spark's own size estimate Catalyst broadcasts it and the salt costs nothing.
    """
    hot = F.broadcast(hot_keys(left, key, hot_rows, max_hot).withColumn("_hot", F.lit(True)))
    dealt = F.pmod(F.xxhash64(*spread_by), F.lit(fanout)).cast("int")
    salted = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), dealt).otherwise(F.lit(0))).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(fanout - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(copied, [key, "_salt"], how).drop("_salt")
