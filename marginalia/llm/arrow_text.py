"""Words and their hashes straight from Arrow string buffers, vectorised and in blocks of bounded size."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
BLOCK = 1 << 19
SHINGLE = 5

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def held(key, make):
    """What ``make`` returns, made once in each Python process (functions travel by value, modules do not)."""
    kept = sys.modules.setdefault("_marginalia_held", types.ModuleType("_marginalia_held")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def mix(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _lower(byte: int) -> int:
    return byte + 32 if 65 <= byte <= 90 else byte


IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
#: A random number per byte, equal for both cases of A-Z, 0 for white space.
BYTE_VALUE = mix(np.array([_lower(b) + 1 for b in range(256)], np.uint64) * np.uint64(_MULTIPLIER)) | np.uint64(1)
BYTE_VALUE[IS_SPACE] = 0


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def _power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make(size):
        return _powers(_MULTIPLIER, size), _powers(_INVERSE, size)

    return held("powers", lambda: make(2 * BLOCK)) if n <= 2 * BLOCK else make(n)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of all rows start; a row's end also ends a word."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    return np.flatnonzero(first)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def hash_runs(data: np.ndarray, starts: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """One hash for the bytes from each start to the next; bytes of value 0 count for nothing at a run's end.

    Every byte is mixed with its place before the sum, so no polynomial identity makes two words meet.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + BLOCK)))
        high = starts[to] if to < len(starts) else len(data)
        local = starts[at:to] - low
        own = values[data[low:high]]
        place = np.arange(high - low) - np.repeat(local, np.diff(np.append(local, high - low)))
        terms = mix(own + place.astype(np.uint64) * _STEP)
        terms[own == 0] = 0
        out[at:to] = np.add.reduceat(terms, local)
        at = to
    return mix(out)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased), and where each row's words begin."""
    data, offsets = utf8(column)
    starts = word_starts(data, offsets)
    return hash_runs(data, starts), np.searchsorted(starts, offsets)


_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(_MULTIPLIER)) | np.uint64(1)


def shingles(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of five-word shingles of all rows, with repeats, and where each row's begin.

    A row of one to four words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(begins)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(counts.dtype))
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    full = np.zeros(len(hashes), np.uint64)
    for k in range(SHINGLE):
        full += padded[k : k + len(hashes)] * _PLACE[k]
    for row in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        low, high = begins[row], begins[row + 1]
        with np.errstate(over="ignore"):
            full[low] = (hashes[low:high] * _PLACE[: high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
    keep = np.arange(len(hashes)) - np.repeat(begins[:-1], counts) < np.repeat(n, counts)
    return mix(full[keep]), np.concatenate([[0], np.cumsum(n)])


def slices(offsets: np.ndarray, size: int):
    """Ranges of rows of about ``size`` items in all; a longer row stands alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(to, rows)
        at = to
