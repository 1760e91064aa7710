"""Likelihood of words under a subword vocabulary, summed over segmentations.

A word is the word-start mark and its bytes. Its segmentations are the paths of
a lattice whose edges are the vocabulary's pieces, or single bytes. forward()
gives the log of the summed weight of all paths; expected() also how often each
piece stands on a path, in the mean over paths by their weight.
"""

from __future__ import annotations

import numpy as np

from . import words as W

MARK = "▁".encode()
GROUP = 16384  #: words in a matrix
SHORT = 64  #: longer words are walked one by one


class Vocabulary:
    """Pieces of a unigram model: log weights by piece. Ids 0 to 255 are bytes."""

    def __init__(self, pieces: list[tuple[bytes, float]], byte_weights: np.ndarray):
        inner = [(p, w) for p, w in pieces if not p.startswith(MARK)]
        first = [(p[len(MARK) :], w) for p, w in pieces if p.startswith(MARK)]
        self.weights = np.concatenate([byte_weights, [w for _, w in inner], [w for _, w in first]])
        self.longest = max([1, *(len(p) for p, _ in inner + first)])
        self.tables = []
        at = 256
        for own in (inner, first):
            h = np.array([self._hash(p) for p, _ in own], dtype=np.uint64)
            order = np.argsort(h)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((h[order], (at + np.arange(len(own)))[order], seen))
            at += len(own)
        bare = [i for i, (p, _) in enumerate(first) if not p]
        self.bare = 256 + len(inner) + bare[0] if bare else None  #: the mark alone

    def reweighted(self, weights: np.ndarray) -> Vocabulary:
        new = object.__new__(Vocabulary)
        new.__dict__.update(self.__dict__, weights=weights)
        return new

    @staticmethod
    def _hash(piece: bytes) -> int:
        up, _ = W.powers(max(64, len(piece) + 1))
        return int(W.mix(np.array([(W._BYTE[np.frombuffer(piece, np.uint8)] * up[: len(piece)]).sum(dtype=np.uint64) + np.uint64(len(piece))], dtype=np.uint64))[0])

    def find(self, hashes: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that are pieces, and those pieces."""
        keys, ids, seen = self.tables[first]
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
        same = keys[k] == hashes[at]
        return at[same], ids[k[same]]


def _edges(vocabulary: Vocabulary, matrix: np.ndarray, sizes: np.ndarray):
    """Yields (from, to, words, pieces) in order of from, then to; from is -1 at
    the mark. matrix: one word a row, padded."""
    rows, width = matrix.shape
    up, down = W.powers(max(width + 1, 64))
    total = np.zeros((width + 1, rows), dtype=np.uint64)
    np.cumsum((W._BYTE[matrix] * up[:width]).T, axis=0, out=total[1:])
    if vocabulary.bare is not None:
        yield -1, 0, np.arange(rows), np.full(rows, vocabulary.bare)
    for start in range(-1, width):
        a = max(start, 0)
        for end in range(a + 1, min(width, a + vocabulary.longest) + 1):
            inside = np.flatnonzero(sizes >= end)
            if not len(inside):
                break
            h = W.mix((total[end, inside] - total[a, inside]) * down[a] + np.uint64(end - a))
            at, piece = vocabulary.find(h, start < 0)
            if len(at):
                yield start, end, inside[at], piece
        if start >= 0 and len(inside := np.flatnonzero(sizes > start)):
            yield start, start + 1, inside, matrix[inside, start].astype(np.int64)


def _sweep(vocabulary: Vocabulary, matrix: np.ndarray, sizes: np.ndarray, counts: np.ndarray | None):
    rows, width = matrix.shape
    ahead = np.full((width + 2, rows), -np.inf)  # row 0 is the mark, row j + 1 place j
    ahead[0] = 0
    kept = []
    for a, b, words, pieces in _edges(vocabulary, matrix, sizes):
        ahead[b + 1, words] = np.logaddexp(ahead[b + 1, words], ahead[a + 1, words] + vocabulary.weights[pieces])
        if counts is not None:
            kept.append((a, b, words, pieces))
    out = ahead[sizes + 1, np.arange(rows)]
    if counts is None:
        return out, None
    back = np.full((width + 2, rows), -np.inf)
    back[sizes + 1, np.arange(rows)] = 0
    expected = np.zeros(len(vocabulary.weights))
    for a, b, words, pieces in reversed(kept):
        via = back[b + 1, words] + vocabulary.weights[pieces]
        back[a + 1, words] = np.logaddexp(back[a + 1, words], via)
        share = np.exp(ahead[a + 1, words] + via - out[words]) * counts[words]
        expected += np.bincount(pieces, weights=share, minlength=len(expected))
    return out, expected


def score(vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray | None = None):
    """Natural log weights of words given as places in data; with counts, also
    the expected number of each piece over so many words."""
    out = np.zeros(len(start))
    expected = np.zeros(len(vocabulary.weights)) if counts is not None else None
    order = np.argsort(end - start, kind="stable")
    sizes = (end - start)[order]
    i = 0
    while i < len(order):
        # words of about one length, fewer of them where they are long
        limit = max(1, min(GROUP, (GROUP * SHORT) // max(1, int(sizes[i]))))
        j = min(i + limit, int(np.searchsorted(sizes, max(sizes[i] + 2, sizes[i] * 5 // 4), side="right")))
        own, n = order[i:j], sizes[i:j]
        width = max(1, int(n[-1]))
        place = start[own][:, None] + np.arange(width)
        matrix = np.where(np.arange(width) < n[:, None], data[np.minimum(place, max(0, len(data) - 1))], 0).astype(np.uint8)
        out[own], more = _sweep(vocabulary, matrix, n, counts[own] if counts is not None else None)
        if more is not None:
            expected += more
        i = j
    return out, expected
