"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of words: ASCII punctuation is ignored, A-Z lower-cased. Its template replaces
numbers (a digit inside, or a number word), units and names (a capital not at the start of a sentence) by
typed placeholders. Windows of ``WINDOW`` words of all benchmark items (a shorter item of at least
``SHORTEST`` words: the whole item) are hashed twice, as words and as template, and joined by hash with
the windows of every document:

* equal words: the passage itself, whatever its case and punctuation;
* equal templates: a re-parameterised passage, if the slots are consistent. All windows of one document and
  item on one diagonal are taken together, and each benchmark value must have been replaced by one and the
  same value everywhere, different values by different ones. Template windows with fewer than ``WORDS``
  ordinary words are too general and not used.

The benchmark side of the join is shipped to the tasks only in parts of at most ``PART_WORDS`` words; a
larger benchmark is joined part by part, with the same result.

Defined cases: null and empty texts or items match nothing; items of fewer than ``SHORTEST`` words are
not looked for; equal rows are judged alike; an empty benchmark leaves every document clean; extra
columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.arrow_text import BYTE_VALUE, IS_SPACE, hash_runs, mix, slices, utf8, word_starts

WINDOW, SHORTEST, WORDS = 13, 6, 6
PART_WORDS = 2_000_000

# What counts as a number word and as a unit.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm m km g mg kg t lb lbs oz l ml mph kmh s h min sec hz khz mhz ghz v w kw kwh mb gb tb inch inches feet foot yard yards mile miles "
         "meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres second seconds minute "
         "minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents pound pounds percent "
         "degree degrees").split()

_BYTES = np.arange(256)
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
KEPT = DIGIT | CAPITAL | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
ENDS_SENTENCE = np.isin(_BYTES, list(b".!?:\n"))
#: What stands for a number, a unit and a name in a template.
SLOT = mix(np.array([101, 102, 103], np.uint64))
_PLACE = mix(np.arange(201, 201 + WINDOW, dtype=np.uint64)) | np.uint64(1)
_GATE_LOG2 = 20


def word_hashes(listed: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(listed, pa.string()))
    return np.sort(hash_runs(data, word_starts(data, offsets)))


def sequence(data: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, units: np.ndarray):
    """Word hashes, template hashes, and where each row's words begin."""
    at = np.flatnonzero((KEPT | IS_SPACE)[data])
    slim = data[at]
    edges = np.searchsorted(at, offsets)
    starts = word_starts(slim, edges)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = hash_runs(slim, starts, BYTE_VALUE)
    begins = np.searchsorted(starts, edges)
    ended = np.cumsum(ENDS_SENTENCE[data], dtype=np.int32)[at[starts]]
    opens = np.ones(len(starts), bool)
    opens[1:] = ended[1:] > ended[:-1]
    opens[begins[:-1][begins[:-1] < len(starts)]] = True
    head = slim[starts]
    after = slim[np.minimum(starts + 1, len(slim) - 1)]
    capital = CAPITAL[head] | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    digit = np.logical_or.reduceat(DIGIT[slim], starts)
    among = lambda listed: listed[np.minimum(np.searchsorted(listed, words), len(listed) - 1)] == words
    template = np.where(capital & ~opens, SLOT[2], words)
    template = np.where(among(units), SLOT[1], template)
    template = np.where(digit | among(numbers), SLOT[0], template)
    return words, template, begins


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash per start of ``length`` neighbouring words, ends of rows not regarded."""
    n = max(0, len(hashes) - length + 1)
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out += hashes[k : k + n] * _PLACE[k]
    return mix(out)


def _index(items: list[tuple[int, str]]) -> dict:
    """Windows of benchmark items: sorted hashes with (item, start) for both kinds, by window length."""
    numbers, units = word_hashes(NUMBER_WORDS), word_hashes(UNITS)
    words, template, begins = sequence(*utf8(pa.array([t for _, t in items], pa.string())), numbers, units)
    lengths = np.diff(begins)
    index = {"numbers": numbers, "units": units, "ids": np.array([i for i, _ in items], np.int64), "begins": begins, "words": words, "template": template, "tables": []}
    slots = np.concatenate([[0], np.cumsum(np.isin(template, SLOT))])
    for length in sorted({min(WINDOW, int(n)) for n in lengths if n >= SHORTEST}):
        rows = [r for r, n in enumerate(lengths) if n == length or (length == WINDOW and n > WINDOW)]
        where = np.concatenate([np.arange(begins[r], begins[r + 1] - length + 1) for r in rows])
        owner = np.concatenate([np.full(lengths[r] - length + 1, r) for r in rows])
        for kind, hashes in (("words", words), ("template", template)):
            found = windows(hashes, length)[where]
            ok = np.ones(len(found), bool)
            if kind == "template":
                n = slots[where + length] - slots[where]
                ok = (n > 0) & (length - n >= min(WORDS, length))
            order = np.argsort(found[ok], kind="stable")
            if not len(order):
                continue
            gate = np.zeros(1 << _GATE_LOG2, bool)
            gate[(found[ok] & np.uint64((1 << _GATE_LOG2) - 1)).astype(np.int64)] = True
            index["tables"].append((kind, length, found[ok][order], owner[ok][order], where[ok][order], gate))
    return index


def _consistent(pairs) -> bool:
    there, back = {}, {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in pairs)


def matches(column: pa.Array, index: dict, block: int = 1 << 20):
    """``(row, item, words in matched windows, by words or by template only)`` of a batch."""
    data, offsets = utf8(column)
    for low, high in slices(offsets, block):
        base = offsets[low]
        words, template, begins = sequence(data[base : offsets[high]], offsets[low : high + 1] - base, index["numbers"], index["units"])
        hits: dict[tuple, set] = {}
        for kind, length, hashes, owner, where, gate in index["tables"]:
            found = windows(words if kind == "words" else template, length)
            at = np.flatnonzero(gate[(found & np.uint64((1 << _GATE_LOG2) - 1)).astype(np.int64)])
            first = np.searchsorted(hashes, found[at])
            last = np.searchsorted(hashes, found[at], side="right")
            row = np.searchsorted(begins, at, side="right") - 1
            ok = (last > first) & (at + length <= begins[row + 1])
            for i, r, a, b in zip(at[ok], row[ok], first[ok], last[ok], strict=True):
                for k in range(a, b):
                    hits.setdefault((r, int(owner[k]), kind, int(i - where[k])), set()).update(range(int(i), int(i) + length))
        best: dict[tuple, tuple] = {}
        for (r, item, kind, shift), places in hits.items():
            if kind == "template":
                pairs = [(int(index["words"][p - shift]), int(words[p])) for p in sorted(places) if template[p] in SLOT]
                if not _consistent(pairs):
                    continue
            old = best.get((r, item), (False, 0))
            best[(r, item)] = max(old, (kind == "words", len(places)))
        for (r, item), (exact, n) in sorted(best.items()):
            yield low + r, int(index["ids"][item]), n, exact


def _parts(benchmark: DataFrame, item: str):
    """The benchmark's index, broadcast in parts of bounded size."""
    items = benchmark.where(F.col("text").isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"), "text")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-total // PART_WORDS))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("i", "text"), F.lit(parts)) == part)
        yield benchmark.sparkSession.sparkContext.broadcast(_index(sorted({tuple(r) for r in own.collect()})))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """``key, item_id, n_words, exact`` for every row of ``docs`` (key, text) and benchmark item it holds."""
    shape = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("item_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("exact", T.BooleanType())])
    found = [docs.select(key, "text").mapInArrow(_finder(shared, key), shape) for shared in _parts(benchmark, item)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _finder(shared, key):
    def find(batches):
        for batch in batches:
            rows = list(matches(batch.column(1), shared.value))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())],
                                             [key, "item_id", "n_words", "exact"])

    return find


def judge(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """``docs`` with ``items``, the ids of the benchmark items found in the text, ascending (empty: clean)."""
    out = docs.select([c for c in docs.columns if c != "items"]).withColumn("items", F.array().cast("array<long>"))
    for shared in _parts(benchmark, item):
        out = _mark(out, text, shared)
    return out


def _mark(rows: DataFrame, text: str, shared) -> DataFrame:
    place, last = rows.columns.index(text), len(rows.columns) - 1

    def mark(batches):
        for batch in batches:
            items = [list(x or ()) for x in batch.column(last).to_pylist()]
            for row, item, _, _ in matches(batch.column(place), shared.value):
                items[row].append(item)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64()))], batch.schema.names)

    return rows.mapInArrow(mark, rows.schema)
