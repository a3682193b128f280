"""Whole Arrow text columns as bytes in numpy: slices, words and 64-bit hashes, no Python strings."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text worked on at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 19
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_STATE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)

#: A random value for each byte; the second table reads A-Z as a-z.
BYTE_VALUES = _STATE
LOWER_VALUES = _STATE.copy()
LOWER_VALUES[65:91] = _STATE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64 and their inverses."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        steps = np.full(size, _BASE, U64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = inverse
        _inverses = np.multiply.accumulate(steps)
    return _powers[:n], _inverses[:n]


def released(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over a task's batches, after which the worker gives memory back that it doesn't use.

    Workers outlive their tasks and idle beside others, and would keep what their largest task freed.
    """

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim is not None:
            trim(0)

    return run


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of h over all bits."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about limit bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j] - P[i] the polynomial of bytes i to j, scaled by the base to the i."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever it stands."""
    inverse = powers(len(prefix))[1]
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of rows that stand one after the other in data."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    np.logical_not(IS_SPACE[data], out=word[1:-1])
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | fresh))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | fresh))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles of so many lower-cased words.

    A row with fewer words has its whole sequence as the one shingle; without words, none.
    """
    starts, ends, row = words(data, offsets)
    rows = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, U64)] * rows
    h = span_hashes(prefix_hash(data, LOWER_VALUES), starts, ends)
    first = np.searchsorted(row, np.arange(rows + 1), "left")
    m = max(len(h) - size + 1, 0)
    s = np.zeros(m, U64)
    for k in range(size):
        s = s * U64(0xD1342543DE82EF95) + h[k : k + m]
    s = mixed(s + U64(size))
    out = []
    for i in range(rows):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= size:
            out.append(np.unique(s[lo : hi - size + 1]))
        elif hi > lo:
            short = U64(0)
            with np.errstate(over="ignore"):
                for x in h[lo:hi]:
                    short = short * U64(0xD1342543DE82EF95) + x
                out.append(mixed(np.array([short + U64(hi - lo)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out
