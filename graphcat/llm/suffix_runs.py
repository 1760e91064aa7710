"""Sorted, front-coded runs of strings, and their merge.

A run is sorted and front-coded: each string is told by how many bytes it
shares with the one before, and the rest. A loser tree merges runs. Every
contender carries the length of the prefix it shares with the last string that
left the tree; the longer one wins without a look at the bytes, and only equal
lengths are compared, from there on. The merge thus never reads a known prefix
again, and hands out the shared length of neighbours for free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def shared_lengths(matrix: np.ndarray) -> np.ndarray:
    """For sorted rows of bytes, the bytes that each shares with the row before."""
    if not len(matrix):
        return np.zeros(0, dtype=np.int64)
    differ = matrix[1:] != matrix[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return np.append(0, first)


def encode(matrix: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """Front-codes sorted rows, of which the first `sizes` bytes count: (heads
    with shared length and rest length, a byte each; the rests)."""
    shared = np.minimum(shared_lengths(matrix), np.minimum(sizes, np.append(0, sizes[:-1])))
    keep = (np.arange(matrix.shape[1]) >= shared[:, None]) & (np.arange(matrix.shape[1]) < sizes[:, None])
    return np.stack([shared, sizes - shared], axis=1).astype(np.uint8).tobytes(), matrix[keep].tobytes()


def decode(heads: bytes, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """The strings of a run, each with its shared length."""
    at, last = 0, b""
    for k in range(0, len(heads), 2):
        shared, rest = heads[k], heads[k + 1]
        last = last[:shared] + rests[at : at + rest]
        at += rest
        yield shared, last


def common(a: bytes, b: bytes, start: int) -> int:
    """How many bytes a and b share, given that they share `start`."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def merge(runs: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """All strings of the runs in order: (shared length with the one before, run, string)."""
    sources = [decode(*r) for r in runs]
    size = 1
    while size < max(1, len(sources)):
        size *= 2
    # a contender is [shared length with the last winner, string, run]; None has run out
    entry: list = [None] * size
    for r, s in enumerate(sources):
        if (x := next(s, None)) is not None:
            entry[r] = [0, x[1], r]

    def better(a, b):
        """(winner, loser) of two contenders with respect to the same last winner."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        n = common(a[1], b[1], a[0])
        first = (len(a[1]) == n or a[1][n] < b[1][n]) if len(b[1]) > n else (len(a[1]) == n and a[2] < b[2])
        win, lose = (a, b) if first else (b, a)
        lose[0] = n  # what it shares with the winner, which will be the last to leave
        return win, lose

    losers: list = [None] * size

    def build(node):
        if node >= size:
            return entry[node - size]
        win, lose = better(build(2 * node), build(2 * node + 1))
        losers[node] = lose
        return win

    top = build(1)
    while top is not None:
        shared, string, r = top
        yield shared, r, string
        x = next(sources[r], None)
        top = None if x is None else [x[0], x[1], r]
        node = (size + r) // 2
        while node:
            top, losers[node] = better(top, losers[node])
            node //= 2
