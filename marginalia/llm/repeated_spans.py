"""Exact repeated spans by longest-previous-factor arrays over buckets of suffixes.

A byte is removed where it lies in a string of ``LENGTH`` bytes that also starts earlier, in a document of
smaller id or before in the same one: where the longest previous factor of some start, capped at
``LENGTH``, is ``LENGTH``. Strings are judged on the input, so first copies stay whole.

One suffix array over a corpus is out of reach, so suffixes are dealt to buckets within which all equal
ones meet: of the ``GRAM``-byte grams of the string of ``LENGTH`` bytes at a start, the one of least hash (the
leftmost) is its anchor. Equal strings have equal anchors at equal places; one anchor serves some forty
neighbouring starts.

1. All anchors are folded into a once-seen and a twice-seen filter (see ``twice_filter``). Starts whose
   anchor is unique in the corpus are first copies and take no further part.
2. The others travel as contexts: the bytes their strings cover, one row per anchor. Contexts that are
   equal within a batch are settled there: only the earliest travels, the rest is removed on its witness.
   So a passage with very many copies sends a few rows per task.
3. A bucket's suffixes are sorted bytewise, ties in text order. Among suffixes that share ``LENGTH`` bytes
   the previous smaller position is then the neighbour before, and the next smaller one lies outside the
   run: the factor reaches the cap wherever the neighbour before is equal. A bucket longer than a batch
   carries on only the contexts that hold some first copy.
4. Removed starts are gathered per document and joined to its bytes.

Defined cases: null is the empty text; texts under ``LENGTH`` bytes have no such string; overlapping copies
count; a null id comes before all others; rows of one id are ordered by a hash of their text, and equal
rows are one document, edited alike. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import twice_filter
from marginalia.llm.arrow_text import _power_pair, mix, slices, utf8

LENGTH, GRAM = 100, 24
GRAMS = LENGTH - GRAM + 1
PIECE = 1 << 19
#: Anchors expected per byte when the filter is sized; only its fill depends on it.
ANCHOR_EVERY = 39
#: Starts sorted at once in a bucket.
SORTED_AT_ONCE = 1 << 19

_VALUE = mix(np.arange(1001, 1257, dtype=np.uint64)) | np.uint64(1)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Of rows in one buffer: anchor hash, first start, last start and row, one entry per anchor and run of starts.

    Also a function for the hashes of byte ranges ``low:high`` of the buffer.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none, None
    power, unpower = _power_pair(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * power[:n])])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * unpower[: n - GRAM + 1])
    marked = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    least, width = marked, 1
    while width * 2 <= GRAMS:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    rest = GRAMS - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least & np.uint64(0xFFFFFF)).astype(np.int32)  # the anchor of each start
    valid = np.zeros(len(at) + 1, np.int8)
    long = np.diff(offsets) >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    fresh = valid.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    fresh[offsets[:-1][long]] = True
    first = np.flatnonzero(fresh)
    ends = valid & np.concatenate([fresh[1:] | ~valid[1:], [True]])
    last = np.flatnonzero(ends)
    return grams[at[first]], first, last, np.searchsorted(offsets, first, side="right") - 1, lambda low, high: mix((sums[high] - sums[low]) * unpower[low])


def pieces(column: pa.Array):
    """``(data, offsets, row of each piece, start of each piece in its row)`` in parts of bounded size.

    A row longer than a part is cut in pieces that overlap by ``LENGTH - 1`` bytes: each start is in one.
    """
    data, offsets = utf8(column)
    for low, high in slices(offsets, PIECE):
        base, size = int(offsets[low]), int(offsets[high] - offsets[low])
        if high - low > 1 or size <= 2 * PIECE:
            yield data[base : base + size], offsets[low : high + 1] - base, np.arange(low, high), np.zeros(high - low, np.int64)
        else:
            for start in range(0, size - LENGTH + 1, PIECE):
                own = data[base + start : min(base + size, base + start + PIECE + LENGTH - 1)]
                yield own, np.array([0, len(own)]), np.array([low]), np.array([start])


def repeats(strings: np.ndarray) -> np.ndarray:
    """Which of the strings (bytes of equal length, in text order) equal an earlier one: the capped factor array.

    Returns for each the index of the first equal string.
    """
    order = np.argsort(strings, kind="stable")
    ranked = strings[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    out = np.empty(len(strings), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return out


def removed_starts(texts: DataFrame) -> DataFrame:
    """``id, mark, first, last``: runs of starts that repeat an earlier string, from ``id, mark, text``."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def hashes(batch):
        found = [anchors(data, offsets)[0] for data, offsets, _, _ in pieces(batch.column(0))]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    seen = spark.sparkContext.broadcast(twice_filter.build(texts.select("text"), hashes, size // ANCHOR_EVERY))

    def contexts(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            marks = batch.column(1).to_numpy()
            found = []
            for data, offsets, rows, starts in pieces(batch.column(2)):
                anchor, first, last, piece, ranges = anchors(data, offsets)
                if not len(anchor):
                    continue
                hit = seen.value.test(anchor)
                anchor, first, last, piece = anchor[hit], first[hit], last[hit], piece[hit]
                shift = starts[piece] - offsets[piece]
                whole = ranges(first, last + LENGTH)
                raw = data.tobytes()
                found.append((anchor, ids[rows[piece]], marks[rows[piece]], first + shift, last + shift, whole, [raw[a:b] for a, b in zip(first, last + LENGTH, strict=True)]))
            if not found:
                continue
            anchor, own, mark, first, last, whole = (np.concatenate([f[k] for f in found]) for k in range(6))
            text = [t for f in found for t in f[6]]
            order = np.lexsort((first, mark, own, whole, anchor))
            same = (anchor[order][1:] == anchor[order][:-1]) & (whole[order][1:] == whole[order][:-1])
            again = np.zeros(len(order), bool)
            again[order[1:]] = same
            head = order[np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))]
            source = np.empty(len(order), np.int64)
            source[order] = head
            itself = (own == own[source]) & (mark == mark[source]) & (first == first[source])
            drop, keep = again & ~itself, ~again
            for which, bucket in ((drop, False), (keep, True)):
                at = np.flatnonzero(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at]), pa.array(mark[at]), pa.array(first[at]), pa.array(last[at]),
                     pa.array((anchor[at] if bucket else mix(whole[at] + first[at].view(np.uint64))).view(np.int64)), pa.array([text[k] for k in at], pa.binary()) if bucket else pa.nulls(len(at), pa.binary())],
                    ["id", "mark", "first", "last", "anchor", "context"])

    runs = "id long, mark long, first long, last long"
    sent = texts.select("id", "mark", "text").mapInArrow(contexts, runs + ", anchor long, context binary")
    # What is settled already comes along, dealt evenly and without its context.
    dealt = sent.repartition("anchor").sortWithinPartitions("anchor", "id", "mark", "first")

    def judge(batches):
        open_rows: pa.Table | None = None
        for batch in batches:
            settled = pc.is_null(batch.column(5))
            yield batch.filter(settled).select(["id", "mark", "first", "last"])
            batch = batch.filter(pc.invert(settled))
            now = pa.Table.from_batches([batch]) if open_rows is None else pa.concat_tables([open_rows, pa.Table.from_batches([batch])])
            total = pc.sum(pc.binary_length(now["context"])).as_py() or 0
            if total < SORTED_AT_ONCE:
                open_rows = now
                continue
            for done, carried in _factors(now, last=False):
                yield done
            open_rows = carried
        if open_rows is not None and open_rows.num_rows:
            for done, _ in _factors(open_rows, last=True):
                yield done

    return dealt.mapInArrow(judge, runs)


def _factors(rows: pa.Table, last: bool):
    """Runs of repeated starts in whole buckets; the last bucket goes on with the contexts that hold a first copy.

    What is carried on comes first in the next batch, so its starts stay first copies and give no new runs.
    """
    rows = rows.combine_chunks()
    anchor, own, mark, first, end = (rows[c].to_numpy() for c in ("anchor", "id", "mark", "first", "last"))
    text, at = np.frombuffer(b"".join(rows["context"].to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(end - first + LENGTH)])
    count = end - first + 1
    low = 0
    fresh = np.zeros(len(anchor), bool)
    while low < len(anchor):
        high = max(low + 1, int(np.searchsorted(at, at[low] + 4 * SORTED_AT_ONCE, side="right")) - 1)
        if high < len(anchor):  # to the end of a bucket
            high = int(np.searchsorted(anchor, anchor[high - 1], side="right"))
        owner = np.repeat(np.arange(low, high), count[low:high])
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count[low:high]) - count[low:high], count[low:high])
        strings = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at[owner] + step].reshape(-1).view(f"S{LENGTH}")
        source = repeats(strings)
        there = owner[source]
        copy = (own[owner] != own[there]) | (mark[owner] != mark[there]) | (first[owner] + step != first[there] + step[source])
        fresh[np.unique(owner[source == np.arange(len(source))])] = True
        opens = copy & ~np.concatenate([[False], copy[:-1] & (owner[1:] == owner[:-1])])
        closes = copy & ~np.concatenate([copy[1:] & (owner[1:] == owner[:-1]), [False]])
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        done = pa.RecordBatch.from_arrays([pa.array(own[owner[a]]), pa.array(mark[owner[a]]), pa.array(first[owner[a]] + step[a]), pa.array(first[owner[b]] + step[b])], ["id", "mark", "first", "last"])
        yield done, rows.slice(0, 0)
        low = high
    if not last:
        tail = np.flatnonzero((anchor == anchor[-1]) & fresh)
        yield done.slice(0, 0), rows.take(pa.array(tail))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept, spans`` per row: the remaining bytes and the removed ranges."""
    held = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(held).alias("mark"), held.alias("text"))
    runs = removed_starts(base).groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    lowest = F.coalesce("id", F.lit(-(1 << 63)))
    met = base.withColumn("id", lowest).join(runs, ["id", "mark"], "left").select("id", "text", "runs")

    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw, removed, kept, spans = data.tobytes(), [], [], []
            for row, found in enumerate(batch.column(2).to_pylist()):
                low, high = int(offsets[row]), int(offsets[row + 1])
                merged: list[list[int]] = []
                for run in found or ():
                    a, b = run["first"], run["last"] + LENGTH
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *[x for span in merged for x in span], high - low]
                kept.append(b"".join(raw[low + a : low + b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(high - low - len(kept[-1]))
                spans.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                                              pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    done = met.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>")
    return done.select(F.nullif("id", F.lit(-(1 << 63))).alias(key), "n_bytes", "n_removed", "n_spans", "kept", "spans")
