"""Runs of bytes in Arrow string columns, found and hashed with numpy.

Texts stay in the UTF-8 buffer that Arrow delivers. Work goes through it in pieces of bounded size, so
memory follows the piece and not the batch or the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Bytes hashed at once.
HASH_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_RANDOM = np.random.default_rng(20240229)
_FACTOR = int(_RANDOM.integers(1 << 62)) | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
#: A random 64-bit value for each byte.
BYTE_VALUES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)


def give_back() -> None:
    """Returns to the system the free memory that Arrow and the C library of this process keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there is none but in glibc
    if trim is not None:
        trim(0)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_FACTOR, HASH_BYTES), _powers(_INVERSE, HASH_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_pieces(
    column: pa.Array, piece_bytes: int = PIECE_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Splits a string column, null as empty, into (first row, bytes, row bounds)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or column.type == pa.null():
        column = pc.fill_null(column.cast(pa.string()), "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    count = len(column)
    if not count:
        return
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32, column.offset + count + 1)
    bounds = bounds[column.offset:].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < count:
        stop = int(np.searchsorted(bounds, bounds[row] + piece_bytes, "right")) - 1
        stop = min(max(stop, row + 1), count)
        yield row, data[bounds[row]:bounds[stop]], bounds[row:stop + 1] - bounds[row]
        row = stop


def runs(
    data: np.ndarray, bounds: np.ndarray, members: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of member bytes within each text."""
    inside = members[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = bounds[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_VALUES
) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are ascending and do not overlap.

    A polynomial over random byte values, taken from running sums, so the cost per byte is constant.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(int(np.searchsorted(ends, low + HASH_BYTES, "right")), first + 1)
        high = int(ends[last - 1])
        up, down = (_UP, _DOWN) if high - low <= HASH_BYTES else (
            _powers(_FACTOR, high - low), _powers(_INVERSE, high - low))
        sums = np.empty(high - low + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(table[data[low:high]] * up[:high - low], out=sums[1:])
        at, to = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64)
        first = last
    return mix(out)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` consecutive word hashes."""
    if len(words) < size:
        return np.empty(0, dtype=np.uint64)
    last = len(words) - size + 1
    out = np.full(last, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(_FACTOR) + words[k:k + last]
    return mix(out)
