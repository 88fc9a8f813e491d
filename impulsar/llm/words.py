"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All of
those separators are ASCII, so the scan runs on the UTF-8 bytes themselves and
agrees with the regular expression ``[^\\x20\\x09-\\x0D]+`` on code points.
Null texts have no words.  Nothing here is truncated; the cost is linear in
the bytes of a batch.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RADIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STRETCH = 1 << 17
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


_RELEASE_BYTES = 1 << 21
_held = 0
#: What a worker keeps from task to task, as long as it does the work that needs it.
KEPT: dict[tuple, object] = {}


def release(done: int | None = None, keep: bool = False) -> None:
    """Give the memory that allocators keep back to the system, once ``done`` bytes of input add up to some, or now.

    Workers live from stage to stage, and what they keep counts against the
    executor; without ``keep``, that ends what other work left in ``KEPT``.
    """
    global _held
    if not keep:
        KEPT.clear()
    _held += _RELEASE_BYTES if done is None else done
    if _held < _RELEASE_BYTES:
        return
    _held = 0
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc only
        libc.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(radix: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, radix, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``len + 1`` offsets; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Word boundaries (byte offsets into ``data``), hashes and row extents of a batch."""

    def __init__(self, column: pa.Array, lower: bool):
        self.data, self.offsets = text_bytes(column)
        n, rows = len(self.data), len(self.offsets) - 1
        inside = ~_SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) if n else inside
        first = inside & (~before | edge[:n])
        after = np.concatenate((inside[1:], [False])) if n else inside
        last = inside & (~after | edge[1:])
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.rows = rows
        if not len(self.starts):
            self.hashes = np.zeros(0, dtype=np.uint64)
            return
        lengths = self.ends - self.starts
        total = np.cumsum(lengths)
        power = powers(_RADIX, int(lengths.max()))
        cuts = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(_STRETCH, total[-1], _STRETCH)), [len(lengths)])))
        sums = np.empty(len(lengths), dtype=np.uint64)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # stretches that fit a cache
            part = lengths[low:high]
            first_at = np.cumsum(part) - part
            place = np.arange(first_at[-1] + part[-1]) - np.repeat(first_at, part)
            letters = self.data[place + np.repeat(self.starts[low:high], part)]
            sums[low:high] = np.add.reduceat(_TABLE[_LOWER[letters] if lower else letters] * power[place], first_at)
        self.hashes = mix64(sums ^ (lengths.astype(np.uint64) * _STEP))

    def row_hashes(self, row: int) -> np.ndarray:
        return self.hashes[self.bounds[row] : self.bounds[row + 1]]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (order matters)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    scale = powers(_STEP, width)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * scale[k]
    return mix64(out)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a short text is one shingle, no words are none."""
    if not len(hashes):
        return hashes
    return np.unique(rolling(hashes, min(width, len(hashes))) ^ (np.uint64(0) if len(hashes) >= width else mix64(np.uint64([len(hashes)]))[0]))
