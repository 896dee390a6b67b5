"""Two Bloom filters, once-seen and twice-seen, built over a whole table and shipped in bounded size.

Every task folds the hashes it reads into the set of filter bits seen at least once and the set seen at
least twice; merging two tasks adds to the second set whatever both have in the first. Only those bits
travel, packed by segment, never a hash per row. A hash that occurs twice anywhere has all its bits in
the twice-seen filter, so the filter names every repeat; it also names a few others, which the caller's
exact check clears. The filter has ``BITS_PER_ITEM`` bits per expected item and never more than
``2 ** MOST_BITS_LOG2`` (256 MB): beyond that size more strangers pass on to the exact check, results
stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_LOG2 = 16
BITS_PER_ITEM = 8
LEAST_BITS_LOG2, MOST_BITS_LOG2 = 20, 31
TASKS_AT_ONCE = 256


class TwiceSeen:
    """The twice-seen filter; ``test`` says for each hash whether it may occur twice."""

    def __init__(self, bits_log2: int, segments: dict[int, bytes]):
        self.bits_log2 = bits_log2
        self.bits = np.zeros(1 << (bits_log2 - 3), np.uint8)
        width = 1 << (SEGMENT_LOG2 - 3)
        for k, packed in segments.items():
            self.bits[k * width : (k + 1) * width] = np.frombuffer(packed, np.uint8)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in places(hashes, self.bits_log2):
            found &= ((self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return found


def places(hashes: np.ndarray, bits_log2: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits_log2) - 1)
    return [hashes & mask, (hashes >> np.uint64(64 - bits_log2)) & mask]


def bits_for(items: int) -> int:
    return min(MOST_BITS_LOG2, max(LEAST_BITS_LOG2, (BITS_PER_ITEM * max(items, 1) - 1).bit_length()))


def build(rows: DataFrame, hashes, items: int) -> TwiceSeen:
    """The filter over what ``hashes(record_batch) -> uint64 array`` yields for all batches of ``rows``."""
    bits_log2 = bits_for(items)

    def fold(batches):
        once, twice, waiting, n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), [], 0

        def settle():
            nonlocal once, twice, n
            fresh = np.concatenate([p for h in waiting for p in places(h, bits_log2)]) if waiting else np.zeros(0, np.uint64)
            # two of a hash's own places may coincide; that only adds a stranger
            values, counts = np.unique(np.concatenate([fresh, once]), return_counts=True)
            twice = np.union1d(twice, values[counts > 1])
            once, n = values, 0
            waiting.clear()

        for batch in batches:
            found = hashes(batch)
            waiting.append(found)
            n += len(found)
            if n > 1 << 20:
                settle()
        settle()
        if len(once):
            group = (once >> np.uint64(SEGMENT_LOG2)).astype(np.int64)
            again = (twice >> np.uint64(SEGMENT_LOG2)).astype(np.int64)
            present = np.unique(group)
            low, high = np.searchsorted(group, present), np.searchsorted(group, present, side="right")
            low2, high2 = np.searchsorted(again, present), np.searchsorted(again, present, side="right")
            one, two = once.astype(np.uint16), twice.astype(np.uint16)
            part = TaskContext.get().partitionId() // TASKS_AT_ONCE
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array(present), "part": pa.array(np.full(len(present), part, np.int64)),
                "once": pa.array([one[a:b].tobytes() for a, b in zip(low, high, strict=True)], pa.binary()),
                "twice": pa.array([two[a:b].tobytes() for a, b in zip(low2, high2, strict=True)], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        seen = np.zeros(1 << SEGMENT_LOG2, np.int64)
        for one, two in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
            seen[np.frombuffer(one, np.uint16)] += 1
            seen[np.frombuffer(two, np.uint16)] += 1
        return pa.table({"segment": table["segment"].slice(0, 1), "once": pa.array([np.packbits(seen > 0, bitorder="little").tobytes()], pa.binary()),
                         "twice": pa.array([np.packbits(seen > 1, bitorder="little").tobytes()], pa.binary())})

    def dense(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(1 << (SEGMENT_LOG2 - 3), np.uint8), np.zeros(1 << (SEGMENT_LOG2 - 3), np.uint8)
        for one, two in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
            a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
            twice |= b | (once & a)
            once |= a
        return pa.table({"segment": table["segment"].slice(0, 1), "once": pa.array([b""], pa.binary()), "twice": pa.array([twice.tobytes()], pa.binary())})

    shape = "segment long, once binary, twice binary"
    packed = rows.mapInArrow(fold, "segment long, part long, once binary, twice binary")
    first = packed.groupBy("segment", "part").applyInArrow(merged, shape)
    whole = first.groupBy("segment").applyInArrow(dense, shape).where(F.col("twice").isNotNull())
    kept = {r.segment: bytes(r.twice) for r in whole.select("segment", "twice").collect() if any(r.twice)}
    return TwiceSeen(bits_log2, kept)
