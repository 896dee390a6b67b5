"""A count-min sketch over digests, built by all tasks, merged by segments and shipped in bounded size.

Each of ``ROWS`` rows has its own counter for a digest; the least of them is the estimate, and never below the true
count. Only "one" or "more" is asked, so counters stop at two and what travels to the tasks is a bit a
counter. A row has at least two counters for every digest expected and at most ``2 ** MOST_LOG2``: beyond that
more digests that occur once are taken for shared, and the caller's exact step clears them; results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marginalia.llm.arrow_text import mix

ROWS = 3
LEAST_LOG2, MOST_LOG2 = 16, 24
SEGMENT_LOG2 = 16
TASKS_AT_ONCE = 256
_CELLS_AT_ONCE = 1 << 20


def lanes(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of 16-byte digests."""
    if not len(digests):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    flat = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


def cells(digests: pa.Array, width_log2: int) -> list[np.ndarray]:
    """A counter number per digest for every row; row ``r`` owns the numbers from ``r << width_log2``."""
    a, b = lanes(digests)
    mask = np.uint64((1 << width_log2) - 1)
    return [(mix(a + np.uint64(r) * b) & mask) | (np.uint64(r) << np.uint64(width_log2)) for r in range(ROWS)]


class Shared:
    """Says of a digest whether it may occur more than once."""

    def __init__(self, width_log2: int, segments: dict[int, bytes]):
        self.width_log2 = width_log2
        size = 1 << (SEGMENT_LOG2 - 3)
        self.bits = np.zeros((1 + ((ROWS << width_log2) >> SEGMENT_LOG2)) * size, np.uint8)
        for k, packed in segments.items():
            self.bits[k * size : (k + 1) * size] = np.frombuffer(packed, np.uint8)

    def test(self, digests: pa.Array) -> np.ndarray:
        """True where the estimate is more than one; False proves a single occurrence."""
        found = np.ones(len(digests), bool)
        for cell in cells(digests, self.width_log2):
            found &= ((self.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return found


def width_for(items: int, most_log2: int = MOST_LOG2) -> int:
    return max(min(LEAST_LOG2, most_log2), min(most_log2, max(1, 2 * items - 1).bit_length()))


def sketch(digests: DataFrame, items: int, most_log2: int = MOST_LOG2) -> Shared:
    """Counts the one column of 16-byte ``digests``, of which about ``items`` are expected."""
    width_log2 = width_for(items, most_log2)

    def fold(batches):
        held, times, waiting, n = np.zeros(0, np.uint64), np.zeros(0, np.uint8), [], 0

        def settle():
            nonlocal held, times, n
            every = np.concatenate([held, *waiting])
            weight = np.concatenate([times, np.ones(len(every) - len(held), np.uint8)])
            held, inverse = np.unique(every, return_inverse=True)
            times = np.minimum(np.bincount(inverse, weight, len(held)), 2).astype(np.uint8)
            waiting.clear()
            n = 0

        for batch in batches:
            waiting.extend(cells(batch.column(0), width_log2))
            n += ROWS * batch.num_rows
            if n > _CELLS_AT_ONCE:
                settle()
        settle()
        segment = (held >> np.uint64(SEGMENT_LOG2)).astype(np.int64)
        present, low = np.unique(segment, return_index=True)
        high = np.append(low[1:], len(held))
        place = held.astype(np.uint16)
        for a in range(0, len(present), 64):
            cut = list(zip(low[a : a + 64], high[a : a + 64], strict=True))
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array(present[a : a + 64]), "part": pa.array(np.full(len(cut), TaskContext.get().partitionId() // TASKS_AT_ONCE, np.int64)),
                "places": pa.array([place[x:y].tobytes() for x, y in cut], pa.binary()), "times": pa.array([times[x:y].tobytes() for x, y in cut], pa.binary())})

    def total(table: pa.Table) -> np.ndarray:
        seen = np.zeros(1 << SEGMENT_LOG2, np.int64)
        for places, times in zip(table["places"].to_pylist(), table["times"].to_pylist(), strict=True):
            seen[np.frombuffer(places, np.uint16)] += np.frombuffer(times, np.uint8)
        return np.minimum(seen, 2).astype(np.uint8)

    def merged(table: pa.Table) -> pa.Table:
        seen = total(table)
        at = np.flatnonzero(seen)
        return pa.table({"segment": table["segment"].slice(0, 1), "places": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "times": pa.array([seen[at].tobytes()], pa.binary())})

    def packed(table: pa.Table) -> pa.Table:
        return pa.table({"segment": table["segment"].slice(0, 1), "bits": pa.array([np.packbits(total(table) > 1, bitorder="little").tobytes()], pa.binary())})

    partial = digests.mapInArrow(fold, "segment long, part long, places binary, times binary")
    first = partial.groupBy("segment", "part").applyInArrow(merged, "segment long, places binary, times binary")
    # a bit a counter: at most 6 MB for all rows of the sketch
    whole = first.groupBy("segment").applyInArrow(packed, "segment long, bits binary")
    return Shared(width_log2, {r.segment: bytes(r.bits) for r in whole.collect() if any(r.bits)})
