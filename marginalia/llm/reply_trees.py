"""Chat formatting over reply trees: root-to-leaf paths by iterative self-joins, ranked, one conversation each.

Messages answer earlier messages of their conversation. A self-join finds every message's parent; joined with itself
the table of parents gives ancestors two, four, eight ... replies up, and on the way the depth, root and summed score
of every message, so the number of joins grows with the logarithm of the longest path. Paths end at messages nobody
answers. They are ranked within their tree by summed score, then length, then id; the wanted ones are
walked upwards with the same tables, longest strides first, which meets every message of a path once. Only ids
travel through these joins; role and text join in at the end.

A turn is written ``[INST]role[/INST]text</s>`` behind one opening ``<s>``. Control strings inside roles and texts
get a backslash behind their first character, and one more where they have some already, so reading back
takes exactly one away. The loss mask is the list of assistant texts as they stand in the output, in code
points and in bytes.

A path becomes one row, as a formatted conversation is one text; nothing else is gathered. A message with very
many answers is a hot key on the side of the answers only, which adaptive execution splits.

Defined cases: a null text or role is empty; a parent that is null, missing, in another conversation or not earlier
than its answer is none, so the message is a root and there are no cycles; rows of one id are one
message, the least of them; a null score counts 0; a null id takes no part; a message without a conversation id
belongs to the conversation null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.storage import stored

OPEN, ROLE, SAID, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(/?s>|/?INST\])"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Break every control string, so none is left; ``unescape`` gives the text back."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def chains(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """A table of turns as messages: every row answers the one before it, nulls of ``order`` first, ties by role and text."""
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.asc_nulls_first(order), "role", "text"))
    name, said = F.coalesce(F.col(conv).cast("string"), F.lit("")), [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    return turns.select(conv, order, *said).withColumn("place", place).select(
        F.col(conv).alias("conv_id"), F.concat_ws(":", name, "place").alias("msg_id"),
        F.when(F.col("place") > 1, F.concat_ws(":", name, F.col("place") - 1)).alias("parent_id"), "place", "role", "text",
        F.lit(0.0).alias("score"))


def ancestors(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``msg_id, conv_id, depth, score, top`` of every message, and the strides ``msg_id, up`` that lead there.

    In stride table ``j``, ``up`` is the message ``2**j`` replies above. A message whose stride passes its root is
    settled and joins no more, so a table holds only the messages at least ``2**j`` deep.
    """
    links = stored(messages.where("msg_id is not null").groupBy("msg_id").agg(F.min(F.struct(
        "conv_id", "place", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")).select("msg_id", "m.*"), "links")
    above = links.select(F.col("msg_id").alias("up"), F.col("conv_id").alias("up_conv"), F.col("place").alias("up_place"))
    parent = (F.col("parent_id") == F.col("up")) & F.col("conv_id").eqNullSafe(F.col("up_conv")) & (F.col("up_place") < F.col("place"))
    now = stored(links.join(above, parent, "left").select(
        "msg_id", "conv_id", "up", F.col("up").isNotNull().cast("long").alias("depth"), "score",
        F.coalesce("up", "msg_id").alias("top")), "ancestors")
    settled, strides = now.where("up is null"), []
    while not (going := now.where("up is not null")).isEmpty():
        strides.append(going.select("msg_id", "up"))
        far = settled.unionByName(going).select(F.col("msg_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"),
                                                F.col("score").alias("_score"), F.col("top").alias("_top"))
        # depth and score so far count what lies below ``up``
        now = stored(going.join(far, "up").select(
            "msg_id", "conv_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
            (F.col("score") + F.col("_score")).alias("score"), F.col("_top").alias("top")), "ancestors")
        settled = settled.unionByName(now.where("up is null"))
    return settled.drop("up"), strides


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """``path, msg_id, above, conv_id, depth, score, root, rank``: the messages of the best ``branches`` paths of every tree (None: all).

    ``path`` is the id of the path's last message, ``above`` counts the replies from it back to ``msg_id``.
    """
    leaves, strides = ancestors(messages)
    if strides:
        leaves = leaves.join(strides[0].select(F.col("up").alias("msg_id")), "msg_id", "left_anti")
    leaves = leaves.select(F.col("msg_id").alias("path"), "msg_id", F.lit(0).cast("long").alias("above"), "conv_id", "depth", "score",
                           F.col("top").alias("root"))
    ranked = Window.partitionBy("root").orderBy(F.desc("score"), F.desc("depth"), "path")
    leaves = leaves.withColumn("rank", F.row_number().over(ranked))
    leaves = stored(leaves if branches is None else leaves.where(F.col("rank") <= branches), "leaves")
    now = leaves.select("path", "msg_id", "above")
    for j in reversed(range(len(strides))):
        further = now.join(strides[j], "msg_id").select("path", F.col("up").alias("msg_id"), (F.col("above") + (1 << j)).alias("above"))
        now = stored(now.unionByName(further), "paths")
    return now.join(leaves.select("path", "conv_id", "depth", "score", "root", "rank"), "path")


def format_paths(messages: DataFrame, branches: int | None = None, learned: str = LEARNED) -> DataFrame:
    """One row per chosen path: ``conv_id, path, root, score, rank, n_turns, formatted, loss``.

    ``loss`` lists the spans ``start, end`` (code points) and ``byte_start, byte_end`` of the texts to learn from,
    those of role ``learned``, in order; ``rank`` is the path's place among the chosen ones of its tree.
    """
    said = messages.where("msg_id is not null").groupBy("msg_id").agg(F.min(F.struct(
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"))
    rows = paths(messages, branches).join(said, "msg_id")
    rows = rows.select("path", "conv_id", "root", "score", "rank", (F.col("depth") - F.col("above")).alias("at"),
                       (F.col("said.role") == learned).alias("learned"),
                       F.concat(F.lit(ROLE), escape(F.col("said.role")), F.lit(SAID)).alias("head"), escape(F.col("said.text")).alias("body"))
    so_far = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = len(CLOSE)
    for name, size in (("", F.length), ("byte_", F.octet_length)):
        whole = F.sum(size("head").cast("long") + size("body") + tail).over(so_far) + len(OPEN)
        rows = rows.withColumn(f"{name}end", whole - tail).withColumn(f"{name}start", F.col(f"{name}end") - size("body"))
    span = F.when(F.col("learned"), F.struct("start", "end", "byte_start", "byte_end"))
    turn = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), span.alias("span"))
    whole = rows.groupBy("path").agg(
        *[F.first(c).alias(c) for c in ("conv_id", "root", "score", "rank")],
        F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "conv_id", "path", "root", "score", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text>>``, as they were before formatting."""
    pieces = F.split(F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted)), r"</s>", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, SAID, 1)
        text = F.substring(piece, F.length(role) + len(SAID) + 1, F.length(piece))
        return F.struct(unescape(F.substring(role, F.lit(len(ROLE) + 1), F.length(role))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped; cut by bytes, so that reading a long conversation stays linear."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(
        raw, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")).cast("string"))), "")
