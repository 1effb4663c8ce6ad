"""Numpy helpers for Arrow string columns inside tasks: word bounds and hashes of many texts at once.

A text's bytes are read where Arrow keeps them; nothing is done per row but what callers loop over themselves.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on (a longer text is one step of its own).
STEP_BYTES = 512 << 10
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def freeing(run: Callable) -> Callable:
    """``run`` over a task's batches, after which the worker, which Spark keeps for later tasks, gives its memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if len(_powers) and len(_powers[0]) > STEP_BYTES + 1:  # of a very long text
            _powers.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, STEP_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _BASE_INV)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = hash of data[s:e] times the base to the power s."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(len(data))[0][: len(data)], dtype=np.uint64)])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes hash alike wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets): the UTF-8 bytes of an Arrow string column, and n + 1 offsets into them.  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``most`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes outside ``separator``; no run crosses a row's end."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(word: np.ndarray, row: np.ndarray, rows: int, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of fewer words, the whole sequence is one."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    with np.errstate(over="ignore"):
        acc = word.copy()
        for j in range(1, k):
            acc = mix(acc[:-1] * np.uint64(0xFF51AFD7ED558CCD) + word[j:]) if len(acc) > 1 else acc[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            found = np.sort(acc[a : b - k + 1])
            keep = np.empty(len(found), bool)
            keep[0], keep[1:] = True, found[1:] != found[:-1]
            out.append(found[keep])
        elif b > a:
            with np.errstate(over="ignore"):
                whole = word[a : a + 1]
                for j in range(a + 1, b):
                    whole = mix(whole * np.uint64(0xFF51AFD7ED558CCD) + word[j : j + 1])
                out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(word[:0])
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of successive row ranges of a text column: words by white space, A-Z lower-cased."""
    data, offsets = texts(column)
    for lo, hi in steps(offsets):
        part, own = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        start, end, row = word_bounds(part, own)
        yield lo, shingles(span_hash(prefix_hash(part), start, end), row, hi - lo, k)
