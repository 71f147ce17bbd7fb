"""Text columns of Arrow batches as bounded blocks of bytes, for numpy kernels."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel handles at once (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20


def _give_back() -> None:
    """Returns freed memory to the system; a C library that can't is left alone."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before the first and after the last, what earlier tasks and Arrow hold in reserve goes back, as idle workers live on."""
    _give_back()
    yield from batches
    _give_back()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets in these bytes) of runs of rows of about ``limit`` bytes."""
    data, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], (off[i : j + 1] - off[i])
        i = j


def word_runs(data: bytes, table: bytes, most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from some ``most`` bytes each; ``table`` maps bytes, separators to spaces."""
    data, at = data.translate(table), 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = randoms(11, 256)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, A-Z lowered, and each row's offsets among them.

    A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    length = ends - starts
    at = np.flatnonzero(solid)
    first = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(first, length)
    top = int(length.max())
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(top, 0x9E3779B97F4A7C15 | 1, np.uint64))
        h = np.add.reduceat(_BYTE[_LOWER[data[at]]] * power[place], first)
        h = mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, off)


def shingle_sets(words: np.ndarray, at: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's sorted set of hashes of ``size`` words running; of fewer words, the hash of all; of none, nothing."""
    c = randoms(23, size)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for j in range(size):
            full += words[j : len(words) - size + 1 + j] * c[j]
        full = mix(full)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(full[a : b - size + 1]))
            elif b > a:
                short = (words[a:b] * c[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix(np.array([short], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
