"""Numpy kernels over Arrow string batches.

They work on the UTF-8 bytes of many texts at once: lower-casing and splitting by lookup tables, word
and shingle hashes by polynomial sums. Hashes depend on the bytes alone, so all executors agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of text that a kernel handles at a time; one longer text is handled alone.
SLICE_BYTES = 300_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-shift hash."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_FACTOR = _U(0xD6E8FEB86659FD93)
_STEP = mix(np.arange(1, 6, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
_powers = np.ones(1, dtype=_U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, _U), np.cumprod(np.full(2 * n, _FACTOR, _U), dtype=_U)])
    return _powers[:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets from 0) for runs of texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of each word, and each text's index of its first word (one more at the end)."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of_texts] = inside[starts_of_texts]
    begin = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    bounds = np.searchsorted(begin, offsets)
    if not len(begin):
        return np.zeros(0, _U), begin, begin, bounds
    of = np.searchsorted(at, begin)
    length = np.diff(np.append(of, len(at)))
    place = np.arange(len(at)) - np.repeat(of, length)
    value = _BYTE[_LOWER[data[at]] if lower else data[at]] * powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, of) + length.astype(_U)), begin, length, bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. Fewer words than a shingle are one; none are none."""
    n = max(0, len(hashes) - size + 1)
    rolled = np.zeros(n, _U)
    for k in range(size if n else 0):
        rolled += hashes[k : k + n] * _STEP[k]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            yield mix((hashes[a:b] * _STEP[: b - a]).sum(keepdims=True) + _U(b - a))
        else:
            yield np.zeros(0, _U)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    for _, data, offsets in slices(column):
        hashes, _, _, bounds = words(data, offsets)
        yield from shingles(hashes, bounds, size)
