"""Deleting comments: edit planning, the parse guard, unified diffs, and writing files back."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.constants import DIFF_CONTEXT
from marginalia.functions.paths import language_of, slashed
from marginalia.functions.text import WS
from marginalia.operators.extraction import slice_bytes
from marginalia.operators.lexing import with_pieces
from marginalia.operators.structure import source_status
from marginalia.plans.durable import durable

col = F.col


def _blank(text: Column) -> Column:
    return text.rlike(rf"^{WS}*\z")


def widen(content: Column, start: Column, end: Column, line_start: Column) -> Column:
    """Whole lines when the comment is alone on them, else the comment and the blanks before it."""
    size = F.octet_length(content)
    prefix = slice_bytes(content, line_start, start).cast("string")
    near = slice_bytes(content, end, end + 1024)
    rest = F.when(_blank(F.decode(near, "ISO-8859-1")), slice_bytes(content, end, size)).otherwise(near)
    after = F.regexp_extract(F.decode(rest, "ISO-8859-1"), r"^([ \t\f\r\x0B]*(?:\n|\z))", 1)
    ends_line = (after != "") | (end >= size)
    trailing_blanks = F.length(F.regexp_extract(prefix, r"([ \t]*)\z", 1))
    return F.when(_blank(prefix), F.struct(
        line_start.cast("int").alias("start"),
        F.when(ends_line, end + F.length(after)).otherwise(end).cast("int").alias("end"),
    )).otherwise(F.struct((start - trailing_blanks).cast("int").alias("start"), end.cast("int").alias("end")))


def _disjoint(spans: pd.Series) -> pd.Series:
    """Sorted spans cut to what no earlier one covers, by a running maximum of their ends."""
    def cut(row):
        start, end = (np.array([span[name] for span in row], np.int64) for name in ("start", "end"))
        reached = np.maximum.accumulate(np.concatenate([[0], end]))[:-1]
        return [{"start": a, "end": b} for a, b in zip(np.maximum(start, reached).tolist(), np.maximum(end, reached).tolist())]

    return pd.Series([cut(row) for row in spans], dtype=object)


def plan_edits(results: DataFrame, sources: DataFrame) -> DataFrame:
    """``(file, content, spans, edited)`` of files the policy deletes comments in.

    Spans are widened, ordered and disjoint; the edited bytes are the pieces between them. One
    row per file, so a file's edits are bounded by the file.
    """
    doomed = results.where("action = 'delete'").groupBy("file").agg(F.sort_array(F.collect_set(
        F.struct("comment.start", "comment.end", "line_start"))).alias("doomed"))
    rows = sources.select("file", "content").join(doomed.hint("shuffle_hash"), "file")
    rows = rows.withColumn("spans", F.array_sort(F.transform(
        "doomed", lambda d: widen(col("content"), d["start"], d["end"], d["line_start"]))))

    rows = rows.withColumn("spans", F.pandas_udf(_disjoint, "array<struct<start:int,end:int>>")("spans"))

    def piece(span, i):
        begin = F.when(i > 0, F.element_at(col("spans"), F.greatest(i, F.lit(1)))["end"]).otherwise(0)
        return F.decode(slice_bytes(col("content"), begin, span["start"]), "ISO-8859-1")

    tail = F.decode(slice_bytes(col("content"), F.element_at("spans", -1)["end"], F.octet_length("content")), "ISO-8859-1")
    edited = F.encode(F.concat(F.array_join(F.transform("spans", piece), ""), tail), "ISO-8859-1")
    return rows.select("file", "content", F.size("doomed").alias("deleted"), "spans", edited.alias("edited"))


def guard(planned: DataFrame) -> DataFrame:
    """Adds ``ok`` and ``error``: the edited file must still parse, and hold the same code.

    The syntax check is lighter than a compiler, so code tokens are compared as well: an edit
    that only takes comments cannot change them. Python is parsed for real, and may lose a
    docstring. The plan is read three times, so it is cut first.
    """
    planned = durable(planned)

    def status(content: str, prefix: str) -> DataFrame:
        named = with_pieces(planned.select("file", col(content).alias("content"))).repartition("file")
        return source_status(named).select(
            "file", *[col(c).alias(f"{prefix}_{c}") for c in ("ok", "error", "digest")])

    checked = planned.join(status("edited", "new"), "file", "left").join(
        status("content", "old").select("file", "old_digest"), "file", "left")
    changed = (language_of(col("file")) != "python") & ~col("new_digest").eqNullSafe(col("old_digest"))
    problem = F.when(~F.coalesce("new_ok", F.lit(True)), col("new_error")).when(changed, F.lit("the edit changes code"))
    return checked.withColumn("problem", problem).select(
        "file", "content", "spans", "edited", col("problem").isNull().alias("ok"),
        F.when(col("problem").isNull(), col("deleted")).otherwise(0).alias("deleted"),
        F.when(col("problem").isNotNull(), F.concat_ws(": ", "file", F.lit("fix-aborted"), F.lit("no edit made"),
                                                       "problem")).alias("error"))


# Unicode white space among the characters of ISO-8859-1
_BLANKS = b"\t\n\x0b\f\r \x85\xa0"


def file_diff(path: str, content: bytes, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """``(hunk, line number, text)`` of the lines a unified diff shows when ``spans`` of the content go.

    Spans and line starts are both in order, so one merge finds the lines each span touches; changed lines a
    context apart share a hunk.
    """
    breaks = np.flatnonzero(np.frombuffer(content, np.uint8) == 10)
    starts = np.concatenate([[0], breaks + 1])
    ends = np.append(breaks, len(content))
    lines = len(starts) - (starts[-1] == len(content))  # nothing after the last line break is no line

    def shown(i: int) -> bytes:
        return content[starts[i] : ends[i]].rstrip(b"\r")

    cuts: dict[int, list[tuple[int, int]]] = {}
    spans = [(a, b) for a, b in spans if a < b]
    first = np.searchsorted(starts, [a for a, _ in spans], side="right") - 1
    final = np.searchsorted(starts, [b for _, b in spans], side="left") - 1
    for (a, b), low, high in zip(spans, first.tolist(), final.tolist()):
        for i in range(low, min(high + 1, lines)):
            cuts.setdefault(i, []).append((max(0, a - int(starts[i])), b - int(starts[i])))
    if not cuts:
        return

    def left(i: int) -> bytes:
        line, at, pieces = shown(i), 0, []
        for a, b in cuts[i]:
            pieces.append(line[at:a])
            at = max(at, b)
        return b"".join([*pieces, line[at:]])

    changed = np.array(list(cuts))
    new = {i: left(i) for i in cuts}
    removed = np.array([not new[i].strip(_BLANKS) for i in cuts])
    gone = np.concatenate([[0], np.cumsum(removed)])
    hunks = np.split(np.arange(len(changed)), np.flatnonzero(np.diff(changed) > 2 * DIFF_CONTEXT + 1) + 1)
    for number, own in enumerate(hunks, 1):
        low, high = max(0, int(changed[own[0]]) - DIFF_CONTEXT), min(lines, int(changed[own[-1]]) + DIFF_CONTEXT + 1)
        taken = int(removed[own].sum())
        n_new, begin = high - low - taken, low + 1 - int(gone[own[0]])
        head = f"@@ -{low + 1},{high - low} +{begin - (n_new == 0)},{n_new} @@\n".encode()
        if number == 1:
            head = f"--- a/{path}\n+++ b/{path}\n".encode() + head
        for i in range(low, high):
            body = b" " + shown(i) if i not in new else b"-" + shown(i)
            if i in new and new[i].strip(_BLANKS):
                body += b"\n+" + new[i]
            yield number, i + 1, head + body
            head = b""


def diff_lines(planned: DataFrame) -> DataFrame:
    """``(file, hunk, line_no, text)`` rows of a unified diff with context lines."""
    names = ["file", "hunk", "line_no", "text"]

    def work(batches):
        for batch in batches:
            for file, path, content, spans in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(file, *row) for row in file_diff(path, content, [(s["start"], s["end"]) for s in spans])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.string(), pa.int32(), pa.int32(), pa.binary()]
    rows = planned.select("file", slashed(col("file")).alias("path"), "content", "spans").mapInArrow(
        work, "file string, hunk int, line_no int, text binary")
    return rows.withColumn("text", col("text").cast("string"))


def unified_diff(planned: DataFrame) -> DataFrame:
    """``(file, diff)``: one text per file."""
    rows = diff_lines(planned).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
    return rows.select("file", F.concat(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), F.lit("\n")).alias("diff"))


def replace_file(path: str, expected: bytes, content: bytes) -> str:
    """Swap a file's bytes in one step if nobody changed it; '' or what went wrong (K9).

    A file that already holds the new bytes is done, so a task may run again.
    """
    try:
        with open(path, "rb") as current:
            found = hashlib.sha256(current.read()).digest()
        if found == hashlib.sha256(content).digest():
            return ""
        if found != hashlib.sha256(expected).digest():
            return f"{path}: no longer what was scored, left alone"
        handle, beside = tempfile.mkstemp(prefix=".edit-", dir=os.path.dirname(path) or ".")
        try:
            with os.fdopen(handle, "wb") as out:
                out.write(content)
                out.flush()
                os.fsync(out.fileno())
            os.chmod(beside, os.stat(path).st_mode)
            os.replace(beside, path)
        except BaseException:
            os.unlink(beside)
            raise
    except OSError as error:
        return f"{path}: {error}"
    return ""


def write_edits(guarded: DataFrame) -> DataFrame:
    """Write files that passed the guard, from the tasks that hold them; ``(file, error)``."""
    root = os.getcwd()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "error": [
                replace_file(os.path.join(root, name), bytes(old), bytes(new))
                for name, old, new in zip(batch["file"], batch["content"], batch["edited"])]})

    return guarded.where("ok").select("file", "content", "edited").mapInPandas(write, "file string, error string")
