"""Columnar word splitting shared by the text operators.

Works on the UTF-8 buffer of an Arrow string column, a few hundred kilobytes at
a time, so memory does not grow with the batch. Only a single text longer than
the slice makes a larger slice. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of the class [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Word bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP**i and its inverse modulo 2**64, for i below n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """The words of documents first_row, first_row + 1, ... of a batch."""

    first_row: int
    data: np.ndarray  #: bytes of these documents, A-Z lower-cased
    start: np.ndarray  #: word starts in data
    end: np.ndarray
    first: np.ndarray  #: for each document, and once past the last, its first word

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """For each word, its document within this slice."""
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets if len(offsets) else np.zeros(1, np.int64), np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(column: pa.Array, is_word: np.ndarray) -> Iterator[Words]:
    """The words of each slice of a string column."""
    offsets, raw = buffers(column)
    for i, j in slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        data = LOWER[raw[offsets[i] : offsets[j]]]
        yield Words(i, data, *bounds(data, at, is_word))


def bounds(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = is_word[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < len(data)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; only those that end within the
    document are meaningful (see complete())."""
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(n):
        out[: len(words) - k] += mix(words[k:] + np.uint64(k + 1)) * np.uint64(2 * k + 0x9E3779B97F4A7C15)
    return mix(out)


def complete(first: np.ndarray, n: int) -> np.ndarray:
    """Which positions have n words before the end of their document."""
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(first[-1]) + n <= last
