"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A conversation becomes a signature, one symbol a turn: the role's initial, whether the text breaks off, or that the turn
has to go. Roles have to read ``(s?(ua)+)?``, so a conversation is in one of four grammar states. What
the cheapest repair of the rest costs depends on the state and on the rest of the signature only. Distinct signatures are
therefore merged from their ends: a node is a suffix, held once however many conversations end in it, and for every
node and state the cost to go and the first edits of the best audit are found once, from the node after it. An audit
is read off by walking the nodes of a signature.

Signatures are distinct rows, dealt over the tasks in ranges of their reversed text: conversations with one ending are
neighbours, a task keeps the nodes of the last signature on a stack and adds only those that differ. Only the
nodes on the border of two ranges are made twice. Many conversations with one signature are one row of the automaton
and meet its audit in a join that adaptive execution splits.

Two heads of edits at one node never are prefixes of each other, since a head is insertions and then one edit of the
turn. So of equally dear audits the least is the one with the least head, and nothing longer has to be compared.

Texts are read twice by one ordered pass each: signatures need digests only, repaired turns go through one shuffle by
conversation and are written as a stream.

Defined cases: a null role or text is one space; turns go by ``order``, nulls first, ties by role and then by a digest of the text, copies
together; a turn's first fault counts (blank; duplicate of an earlier turn; truncated); an empty role has no initial and so
cannot be kept; conversations that only ``ids`` name, or that have no turns, need no edits; a null conversation id is a
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.storage import stored

# fixed values: what the edits cost, and the grammar of roles
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: State after the role a state waits for: at the start and after ``s`` a user, after a user an assistant, and so on.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FOLLOWS = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
WAITS = ("user", "user", "assistant", "user")
ENDING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
LEGAL = ("su", "ua", "au")
_SPACE = r"[\x20\x09-\x0D]"
#: Reversed signatures are dealt over tasks by so many symbols.
RANGE_SYMBOLS = 64


def _moves(symbol: str, state: int) -> list[tuple[int, str, int]]:
    """``(cost, head, next state)`` of every way past a symbol: insertions, then one edit of the turn."""
    found = []
    broken = TRUNCATED if symbol.isupper() else 0
    for k in range(3):
        cost, head = k * INSERT, "I" * k
        found.append((cost + DELETE, head + "D", state))
        if symbol != "x":
            own = symbol.lower()
            if own == "s" and state == START:
                found.append((cost + KEEP + broken, head + "K", AFTER_S))
            elif own == WAITS[state][0]:
                found.append((cost + KEEP + broken, head + "K", FOLLOWS[state]))
            found.append((cost + REROLE + broken, head + "R", FOLLOWS[state]))
        state = FOLLOWS[state]
    return found


MOVES = {symbol: [_moves(symbol, state) for state in range(4)] for symbol in "xsuaoSUAO"}


def add_node(symbol: str, costs: tuple) -> tuple[tuple, tuple]:
    """Cost to go and ``(head, next state)`` for every state of the node before one with ``costs``."""
    best = [min((cost + costs[to], head, to) for cost, head, to in MOVES[symbol][state]) for state in range(4)]
    return tuple(b[0] for b in best), tuple(b[1:] for b in best)


def audits(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of distinct ``signature``s: the automaton, built and walked range by range."""
    def work(batches):
        last, costs, choices = "", [tuple(c for c, _ in ENDING)], []
        for batch in batches:
            spent, written = [], []
            for word in batch.column(0).to_pylist():
                same, most = 0, min(len(word), len(last))
                while same < most and word[same] == last[same]:
                    same += 1
                del costs[same + 1 :], choices[same:]
                for symbol in word[same:]:
                    node, choice = add_node(symbol, costs[-1])
                    costs.append(node)
                    choices.append(choice)
                last, state, heads = word, START, []
                for choice in reversed(choices):
                    head, state = choice[state]
                    heads.append(head)
                heads.append(ENDING[state][1])
                spent.append(costs[-1][START])
                written.append("".join(heads))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spent, pa.int64()), pa.array(written, pa.string())], ["reversed", "cost", "audit"])

    turned = signatures.select(F.reverse("signature").alias("reversed")).distinct()
    dealt = turned.repartitionByRange(F.substring("reversed", 1, RANGE_SYMBOLS)).sortWithinPartitions("reversed")
    return dealt.mapInArrow(work, "reversed string, cost long, audit string").select(F.reverse("reversed").alias("signature"), "cost", "audit")


def _turns(turns: DataFrame, conv: str, order: str) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(F.col(conv).alias("conv"), F.col(order).alias("at"), role.alias("role"), text.alias("text"),
                        F.unhex(F.sha2(text, 256)).alias("said"))


def judged(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """``conv, place, at, role, fault, symbol, illegal, fresh`` per turn: its place in order, its first fault and its symbol.

    ``illegal`` marks a turn whose initial may not follow the one before, ``fresh`` the first turn of its number.
    """
    bare = F.regexp_replace("text", rf"{_SPACE}+\z", "")
    rows = _turns(turns, conv, order).select(
        "conv", "at", "role", "said", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("broken"))
    copies = Window.partitionBy("conv", "role", "said").orderBy(F.asc_nulls_first("at"))
    in_order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("at"), "role", "said", "copy")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("copy", F.row_number().over(copies)).withColumns({
        "place": F.row_number().over(in_order),
        "before": F.lag(F.struct(initial.alias("initial"), "at")).over(in_order),
        "fault": F.when(F.col("blank"), "blank").when(F.col("copy") > 1, "duplicate").when(F.col("broken"), "truncated")})
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.select(
        "conv", "place", "at", "role", "fault", symbol.alias("symbol"),
        (F.col("before").isNotNull() & ~F.concat("before.initial", initial).isin(*LEGAL)).alias("illegal"),
        (F.col("at").isNotNull() & ~F.col("at").eqNullSafe(F.col("before.at"))).alias("fresh"))


def reports(turns: DataFrame, conv: str = "conv_id", order: str = "turn", ids: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost, audit`` of every conversation."""
    def count(condition: Column) -> Column:
        return F.count_if(condition).cast("long")

    fault = F.col("fault")
    held = judged(turns, conv, order).groupBy("conv").agg(
        F.coalesce((F.max("at") - F.min("at") + 1 - F.count_if("fresh")).cast("long"), F.lit(0)).alias("gaps"),
        *[count(fault == name).alias(name) for name in ("blank", "duplicate", "truncated")], count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda s: s["symbol"]), "").alias("signature"))
    if ids is not None:
        every = ids.select(F.col(conv).alias("conv_id")).distinct()
        held = every.join(held, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("conv_id", "conv")
        held = held.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal"]).fillna("", ["signature"])
    held = stored(held, "signatures")
    return held.join(audits(held.select("signature")), "signature").select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "signature", "cost", "audit")


def repaired(turns: DataFrame, report: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """``conv_id, n, edit, role, text``: the turns of every repaired conversation, numbered from 1; deleted ones are gone.

    Rows of one conversation leave one task together and in order.
    """
    rows = _turns(turns, conv, order).withColumn("turn", F.lit(True)).unionByName(
        report.select(F.col("conv_id").alias("conv"), "audit", F.lit(False).alias("turn")), allowMissingColumns=True)
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", F.asc_nulls_first("at"), "role", "said").select("conv", "turn", "audit", "role", "text")
    shape = T.StructType([T.StructField("conv_id", dealt.schema["conv"].dataType), T.StructField("n", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])

    def work(batches):
        at, audit, k, state, n, out, size, kind = None, "", 0, START, 0, [], 0, None

        def insert():
            nonlocal k, state, n
            while k < len(audit) and audit[k] == "I":
                n += 1
                out.append((at, n, "I", WAITS[state], ""))
                k, state = k + 1, FOLLOWS[state]

        def made():
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], shape.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, is_turn, found, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_turn:
                    insert()
                    at, audit, k, state, n = own, found, 0, START, 0
                    continue
                insert()
                edit, k = audit[k], k + 1
                if edit == "D":
                    continue
                n += 1
                if edit == "R":
                    role, state = WAITS[state], FOLLOWS[state]
                else:
                    state = AFTER_S if state == START and role[:1] == "s" else FOLLOWS[state]
                out.append((at, n, edit, role, text))
                size += len(text)
                if len(out) >= 1 << 13 or size > 1 << 20:
                    yield made()
                    out.clear()
                    size = 0
        insert()
        if out:
            yield made()

    return dealt.mapInArrow(work, shape)


def fingerprints(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of ``role:text`` of the turns ``repaired`` gives, newline-joined, as they stream by."""
    shape = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def work(batches):
        at, state, kind = None, None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, n, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = f"{role}:{text}".encode()
                if n == 1:
                    if state:
                        yield row()
                    at, state = own, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
        if state:
            yield row()

    return rows.select("conv_id", "n", "role", "text").mapInArrow(work, shape)
