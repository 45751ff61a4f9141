"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, the same as
the pattern ``[^\\x20\\x09-\\x0D]+`` on the decoded text.  Everything works on
the UTF-8 buffer of a slice of documents at once, so no Python object is made
per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_POW: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    if not _POW or len(_POW[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _POW[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POW[0], _POW[1]


def byte_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Polynomial hashes, not mixed, of pieces of a buffer of bytes."""
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


@dataclass
class Words:
    """Words of the documents ``first`` to ``first + len(bounds) - 1`` of a batch.

    ``offsets[i]:offsets[i + 1]`` are the bytes of document i in ``data`` and
    ``bounds[i]:bounds[i + 1]`` its words; ``starts`` and
    ``ends`` are byte offsets in ``data``; ``hashes`` has 64 bits a word.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; a null is an empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def split(column: pa.Array, lower: bool, chunk_bytes: int = CHUNK_BYTES, separators: np.ndarray = _SPACE) -> Iterator[Words]:
    """Words of a string column, in slices of about ``chunk_bytes`` of text.

    A longer document makes a slice of its own.  ``separators`` marks the bytes
    that stand between words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = _strings(column)
    n, first = len(column), 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1
        last = min(n, max(last, first + 1))
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        size = len(part)
        if size:
            space = separators[part]
            cut = np.empty(size + 1, bool)  # a document begins or ends here, or white space stands before
            cut[0] = cut[size] = True
            cut[1:size] = space[:-1]
            cut[at[at < size]] = True
            starts = np.flatnonzero(~space & cut[:-1])
            # a word ends before white space or before the next document
            stop = np.empty(size, bool)
            stop[:-1] = space[1:]
            stop[-1] = True
            inner = at[(at > 0) & (at < size)]
            stop[inner - 1] = True
            ends = np.flatnonzero(~space & stop) + 1
            hashes = mix64(byte_sums(part, starts, ends, lower))
        else:
            starts = ends = np.zeros(0, np.int64)
            hashes = np.zeros(0, np.uint64)
        yield Words(first, part, at, np.searchsorted(starts, at), starts, ends, hashes)
        first = last


_COEFFICIENTS = np.random.default_rng(70_001).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, documents' borders not regarded."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = hashes[:m] * _COEFFICIENTS[0]
        for k in range(1, n):
            out += hashes[k : k + m] * _COEFFICIENTS[k]
        return mix64(out)
    up, down = _powers(len(hashes))
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix64((total[n:] - total[:-n]) * down[:m])


def shingle_sets(words: Words, n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document.

    With fewer than n words the whole sequence is the one shingle; without
    words the set is empty.
    """
    all_windows = windows(words.hashes, n)
    bounds = words.bounds.tolist()
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            own = np.sort(all_windows[a : b - n + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield windows(words.hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)
