"""Findings to scorer requests: grouping by block, packing under the size cap, billing, budget."""

from __future__ import annotations

from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.scoring import (
    asks_commented_out, cost_usd, estimate_tokens, question_bytes, shared_tokens, state, to_axis)

ITEM = "struct<file:string,ord:bigint,id:string,slot:string,kind:string,block_text:string,growth:int>"


def place_items(slots: list[str], growths: list[int], state_bytes: int, cap: int) -> list[tuple[int, int]]:
    """Request number and size of every item of a block, in one pass.

    Greedy in order: an item that would lift a non-empty request over the cap opens the next
    one, which repeats the state; a slot asked before in the same request adds nothing.
    """
    number, size, asked, placed = 0, state_bytes, set(), []
    for slot, growth in zip(slots, growths):
        adds = 0 if slot in asked else growth
        if asked and floor((size + adds) / C.BYTES_PER_TOKEN) + C.TOKENS_PER_REQUEST > cap:
            number, size, adds = number + 1, state_bytes, growth
            asked.clear()
        asked.add(slot)
        size += adds
        placed.append((number, size))
    return placed


def pack(slots: Column, growths: Column, state_bytes: Column, cap: int = C.MAX_REQUEST_TOKENS) -> Column:
    """``array<struct<bin, size>>``: ``place_items`` of every row's arrays."""
    def placed(slots: pd.Series, growths: pd.Series, state_bytes: pd.Series) -> pd.Series:
        return pd.Series([[{"bin": b, "size": n} for b, n in place_items(list(s), g.tolist(), int(z), cap)]
                          for s, g, z in zip(slots, growths, state_bytes)], dtype=object)

    return F.pandas_udf(placed, "array<struct<bin:int,size:int>>")(slots, growths, state_bytes)


def requests(findings: DataFrame, rubric, cap: int = C.MAX_REQUEST_TOKENS) -> DataFrame:
    """``(req_id, state, items, n_findings, size_bytes, est_tokens)``: what is sent to the scorer.

    A documentation block is one group, and bounded by one comment of one file. Findings without
    a block are grouped by id: copies ask the same questions, so a count stands for all of them
    and an id that fills a third of the corpus is still one row after the map-side combine.
    """
    rows = findings.select(
        "file", "ord", "id", "slot", "kind", "block", "block_text",
        question_bytes(rubric, F.col("kind"), F.col("slot"), F.col("block_text")).alias("growth"),
        state(F.col("context"), F.col("code_text"), F.col("block_text"), F.col("comment_text")).alias("state"))
    item = F.struct("file", "ord", "id", "slot", "kind", "block_text", "growth").cast(ITEM)

    single = rows.where("block = ''").groupBy("id").agg(
        F.min(F.struct("file", "ord", item.alias("item"), "state")).alias("first"), F.count("*").alias("n_findings"))
    single = single.select(
        F.col("id").alias("req_id"), "first.state", F.array("first.item").alias("items"), "n_findings",
        (F.octet_length("first.state") + F.col("first.item.growth")).alias("size_bytes"))

    blocks = rows.where("block <> ''").groupBy("block").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.min(F.struct("file", "ord", "state")).alias("first"))
    part = lambda name: F.transform("items", lambda item: item[name])
    blocks = blocks.withColumn("placed", pack(part("slot"), part("growth"), F.octet_length("first.state"), cap))
    placed = blocks.select("block", "first.state", F.explode(F.arrays_zip("items", "placed")).alias("at"))
    # items of one request stay an array, which the cap bounds; its size is that of the last one placed
    blocks = placed.groupBy("block", "at.placed.bin").agg(
        F.first("state").alias("state"), F.sort_array(F.collect_list("at.items")).alias("items"),
        F.count("*").alias("n_findings"), F.max("at.placed.size").alias("size_bytes")).select(
        F.concat_ws("#", "block", "bin").alias("req_id"), "state", "items", "n_findings", "size_bytes")
    return single.unionByName(blocks).withColumn("est_tokens", estimate_tokens(F.col("size_bytes")))


def estimated_tokens(planned: DataFrame) -> DataFrame:
    """Input tokens all requests are expected to bill."""
    return planned.agg(F.coalesce(F.sum("est_tokens"), F.lit(0)).alias("est_tokens"))


#: Rows one window of the running total sums, on average, and hex digits that tell the windows of a level apart.
ROWS_IN_WINDOW = 1 << 16
DIGITS = 3


def running_spend(rows: DataFrame, key: str, amount: str, name: str = "spent_before", *, rows_in_window: int = ROWS_IN_WINDOW) -> DataFrame:
    """What was spent before each row, in the order of the key's digest.

    Prefix sums in levels: rows are summed by ever longer prefixes of the digest until a prefix
    holds some ``rows_in_window`` rows. Each level adds up siblings of one parent, ``16 ** DIGITS`` at most, and the
    last one the rows of one prefix, so every window is small however many rows there are.
    """
    rows = rows.withColumn("_digest", F.md5(F.col(key).cast("binary")))
    count, levels = rows.count(), 0
    while count > rows_in_window * 16 ** (DIGITS * levels) and levels * DIGITS < 32:
        levels += 1

    def prefix(level: int) -> Column:
        return F.substring("_digest", 1, DIGITS * level)

    totals = {}
    for level in range(levels, 0, -1):  # the sums of a level add up those of the next finer one
        finer = totals.get(level + 1, rows.select("_digest", F.col(amount).alias("_total")))
        totals[level] = finer.groupBy(prefix(level).alias("_digest")).agg(F.sum("_total").alias("_total"))
    offsets = None
    for level in range(1, levels + 1):
        siblings = Window.partitionBy(prefix(level - 1)).orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
        own = totals[level].select("_digest", F.coalesce(F.sum("_total").over(siblings), F.lit(0)).alias("_offset"))
        if offsets is not None:
            above = offsets.select(F.col("_digest").alias("_parent"), F.col("_offset").alias("_above"))
            own = own.withColumn("_parent", prefix(level - 1)).join(above, "_parent").select("_digest", (F.col("_offset") + F.col("_above")).alias("_offset"))
        offsets = own
    inside = Window.partitionBy(prefix(levels)).orderBy("_digest", key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    if offsets is not None:
        offsets = offsets.withColumnRenamed("_digest", "_prefix")
        rows = rows.withColumn("_prefix", prefix(levels)).join(offsets, "_prefix").withColumn(name, F.col(name) + F.col("_offset")).drop("_prefix", "_offset")
    return rows.drop("_digest")


def verdicts(scored: DataFrame) -> DataFrame:
    """Scored requests to one verdict per id.

    ``scored`` is requests plus ``input_tokens``, ``model`` and ``answers`` by slot. Of several
    verdicts for one id the one of the last request wins.
    """
    rows = scored.withColumn("item", F.explode("items")).withColumn(
        "a", F.element_at(F.filter("answers", lambda x: x["slot"] == F.col("item.slot")), 1))
    tokens = shared_tokens(F.col("input_tokens"), F.col("n_findings"))
    disabled = F.when(asks_commented_out(F.col("item.kind")), F.col("a.commented_out")).otherwise(0.0)
    verdict = F.struct(
        to_axis(F.col("a.accuracy"), F.col("a.accuracy_confidence"), F.col("a.accuracy_label")).alias("accuracy"),
        to_axis(F.col("a.usefulness"), F.col("a.usefulness_confidence"), F.col("a.usefulness_label")).alias("usefulness"),
        F.struct(F.col("a.overreach").alias("prob")).alias("overreach"), F.struct(disabled.alias("prob")).alias("commented_out"),
        F.struct(tokens.alias("input_tokens"), cost_usd(tokens).alias("cost_usd")).alias("usage"), F.col("model"))
    return rows.select(F.col("item.id").alias("id"), verdict.alias("verdict"), F.struct("item.file", "item.ord").alias("at")).groupBy(
        "id").agg(F.max_by("verdict", "at").alias("verdict"))
