"""The prefix trie of all conversations, whose shared prefixes alone are shuffled.

A prefix is named by a chained digest: SHA-256 over the digest of the prefix before and of the turn, cut to 16 bytes.
One pass over the conversations, each read in order as a stream, names all prefixes. A count-min sketch
(``count_min``) then screens them: an estimate of one proves that no other conversation starts
the same way, so such a prefix and all below it are nodes of their own, written where they are. The rest may be shared,
goes through exact grouping by digest, and estimates that were too high are corrected there.

Sums over subtrees need no descent. A node's members shrink downwards, so a conversation that is the
smallest member of a node is so of every deeper prefix of its own. Hence every node has one conversation that stands for it
and the sum over a subtree is a sum over the members of its top: a member adds what it holds from that
depth on and does not stand for.

Members of very common prefixes (the root holds all) are summed before they are shuffled, and joined with one row per
prefix, which adaptive execution splits. The list of conversations that end at one node is digested from ordered
slices, never gathered. Only one conversation is read in sequence, as a stream; texts never leave the first scan.

Defined cases: null roles and texts are empty; turns go by ``order``, nulls first, ties by role and then by a digest of role and
text; rows without a conversation id take no part; repeated rows are turns of their own; ``ids`` may name
conversations without turns, members of the root only; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.count_min import MOST_LOG2, sketch
from marginalia.llm.storage import stored

ROOT = hashlib.sha256(b"root").digest()[:16]
#: Ids joined into one slice of a list of ends before the slices meet.
SLICE_IDS = 1 << 16


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def prefixes(turns: DataFrame, ids: DataFrame | None, conv: str, order: str) -> DataFrame:
    """``conv, depth, digest, parent, words, through, ends, ends_next`` of every prefix of every conversation.

    ``words`` counts the last turn, ``through`` all turns so far; ``ends`` says that the conversation ends here,
    ``ends_next`` that it does one turn later.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.lit(True).alias("turn"), F.col(order).alias("at"), role.alias("role"), said.alias("said"), words_in(text).alias("words"))
    if ids is not None:
        rows = rows.unionByName(ids.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.lit(False).alias("turn")).distinct(), allowMissingColumns=True)
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", F.asc_nulls_first("at"), "role", "said").select("conv", "turn", "said", "words")
    names = ["conv", "depth", "digest", "parent", "words", "through", "ends", "ends_next"]
    shape = T.StructType([T.StructField("conv", dealt.schema["conv"].dataType), T.StructField("depth", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("parent", T.BinaryType()),
                          T.StructField("words", T.LongType()), T.StructField("through", T.LongType()), T.StructField("ends", T.BooleanType()), T.StructField("ends_next", T.BooleanType())])

    def work(batches):
        sha, waiting, at, out = hashlib.sha256, [], None, []

        def finish():
            for k, row in enumerate(reversed(waiting)):
                row[6], row[7] = k == 0, k == 1
            out.extend(waiting)
            waiting.clear()

        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            for conv_id, turn, said, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != at:
                    finish()
                    at = conv_id
                    waiting.append([conv_id, 0, ROOT, None, 0, 0, False, False])
                if turn:
                    last = waiting[-1]
                    waiting.append([conv_id, last[1] + 1, sha(last[2] + said).digest()[:16], last[2], words, last[5] + words, False, False])
                    if len(waiting) > 2:
                        out.append(waiting.pop(0))
            if len(out) >= 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return dealt.mapInArrow(work, shape)


def screened(rows: DataFrame, shared) -> DataFrame:
    """Adds ``open``: the prefix may be shared; ``below``: its parent may be."""
    filled = rows.sparkSession.sparkContext.broadcast(shared)

    def work(batches):
        for batch in batches:
            depth = batch.column("depth").to_numpy(zero_copy_only=False)
            opened = filled.value.test(batch.column("digest")) | (depth == 0)
            below = filled.value.test(batch.column("parent").fill_null(ROOT)) | (depth <= 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(opened), pa.array(below)], [*batch.schema.names, "open", "below"])

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("open", T.BooleanType()), T.StructField("below", T.BooleanType())]))


def end_lists(ends: DataFrame) -> DataFrame:
    """``digest, ends_sha256``: SHA-256 of the comma-joined ids ``conv`` of each ``digest``, ascending.

    Sorted ranges are joined to slices first, whoever holds them; the slices of one digest then meet in order and are digested as a stream.
    """
    def sliced(batches):
        at, first, held = None, None, []
        for batch in batches:
            out = []
            for digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest != at or len(held) >= SLICE_IDS:
                    if held:
                        out.append((at, first, ",".join(held)))
                    at, first, held = digest, conv, []
                held.append(str(conv))
            if out:
                yield made(out, batch.schema)
            schema = batch.schema
        if held:
            yield made([(at, first, ",".join(held))], schema)

    def made(out, schema):
        digests, firsts, pieces = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(firsts, schema.field(1).type), pa.array(pieces, pa.string())], ["digest", "first", "piece"])

    def hashed(batches):
        at, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

        for batch in batches:
            for digest, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest != at:
                    if state:
                        yield row()
                    at, state = digest, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
        if state:
            yield row()

    shape = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("first", ends.schema["conv"].dataType), T.StructField("piece", T.StringType())])
    slices = ends.select("digest", "conv").repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv").mapInArrow(sliced, shape)
    return slices.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "piece").mapInArrow(hashed, "digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", order: str = "turn", ids: DataFrame | None = None, most_log2: int = MOST_LOG2) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``role`` and ``text`` besides the columns ``conv`` and ``order`` name. ``conv_id`` is the node's smallest
    member; ``saved_tokens`` sums over the subtree the words of each node's last turn times the members but one.
    """
    rows = stored(prefixes(turns, ids, conv, order), "prefixes")
    below_root = rows.where("depth > 0").select("digest")
    shared = sketch(below_root, below_root.count(), most_log2)
    rows = stored(screened(rows, shared), "screened")
    alone = rows.where("not open and not below")
    opened = rows.where("open").drop("parent", "open", "below")

    def end_of_one(ends: Column) -> Column:
        return F.sha2(F.when(ends, F.col("conv").cast("string")).otherwise(F.lit("")).cast("binary"), 256)

    def single(source: DataFrame, depth: Column, parent: Column, ends: Column) -> DataFrame:
        one = F.lit(1).cast("long")
        return source.select(F.col("conv").alias("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"),
                             F.when(ends, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                             end_of_one(ends).alias("ends_sha256"))

    tails = single(alone, F.col("depth"), F.col("conv"), F.col("ends"))

    groups = opened.groupBy("digest").agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n"), F.count_if("ends").alias("n_ends"))
    own = Window.partitionBy("conv")
    downward = own.orderBy("depth")
    stands = F.col("conv") == F.col("least")
    adjoins = F.col("next.depth") == F.col("depth") + 1
    members = opened.join(groups, "digest").withColumns({
        "stands": stands,
        "next": F.lead(F.struct("depth", stands.alias("stands"))).over(downward), "above": F.lag(F.struct("depth", "least")).over(downward),
        # words down to the last prefix this conversation does not stand for
        "kept_by_others": F.coalesce(F.max(F.when(~stands, F.col("through"))).over(own), F.lit(0)),
        # the conversation stands for a leaf: nobody goes on from where it ends; ends that are proven single always do
        "leaf": F.coalesce(F.max(F.when(F.col("ends"), (stands & (F.col("n") == F.col("n_ends"))).cast("long"))).over(own), F.lit(1)),
    }).withColumns({
        "goes_alone": ~F.col("ends") & ~F.coalesce(adjoins, F.lit(False)),
        "parent_conv": F.when(F.col("depth") > 0, F.when(F.col("above.depth") == F.col("depth") - 1, F.col("above.least")).otherwise(F.col("conv"))),
    })
    members = stored(members, "members")
    child = F.when(F.col("ends"), 0).when(F.col("goes_alone"), 1).otherwise(F.col("next.stands").cast("int"))
    saved = F.greatest(F.col("kept_by_others") - (F.col("through") - F.col("words")), F.lit(0))
    nodes = members.groupBy("digest").agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.max(F.when(F.col("stands"), F.col("parent_conv"))).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.sum(child).cast("long").alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"))
    ends = end_lists(members.where("ends"))
    nodes = nodes.join(ends, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).drop("digest")
    # the first single prefix below a shared one is known by its parent's row
    tops = single(members.where("goes_alone"), F.col("depth") + 1, F.col("least"), F.col("ends_next"))
    return nodes.unionByName(tops).unionByName(tails)
