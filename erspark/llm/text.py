"""Byte-level numpy helpers over Arrow string columns.

Strings stay UTF-8 buffers with offsets: nothing is decoded row by row. Work goes in
slices of bounded bytes, so the memory of a task does not follow the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text is one slice.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

_rng = np.random.default_rng(20240229)
#: Random 64-bit values for bytes, and an odd multiplier, of the polynomial hash.
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with about ``limit`` bytes each, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


_powers = {}
_kept: dict[str, dict] = {}


def keep(owner: str, state: dict) -> dict:
    """Registers what an operator keeps in a worker between tasks, and frees other operators' state.

    Workers are used again by later stages, which should not pay for earlier ones' memory.
    """
    for name in [n for n in _kept if n != owner]:
        _kept.pop(name).clear()
    if owner:
        _kept[owner] = state
    else:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library gives memory back in its own time
            pass
    return state


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
    """Prefix sums P of keys[byte] * BASE**i; P has one more entry than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(keys[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the span lies; mixes in its length."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), BASE_INVERSE)[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of True that do not cross row offsets."""
    n = len(mask)
    if n == 0:
        z = np.empty(0, np.int64)
        return z, z, z
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] | head[1:n]
    starts = np.flatnonzero(begin)
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | head[1:n]
    ends = np.flatnonzero(stop) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends
