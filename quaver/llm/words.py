"""Words, word hashes and shingles of many texts at once, as numpy arrays.

A word is a run of bytes other than \\x20 and \\x09-\\x0D; A-Z count as a-z. Hashes are 64 bits wide: a sum of bytes
times random odd numbers by place, then mixed, so that words or shingles inside one comparison don't meet by chance.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 5

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_PLACES = mix(np.arange(4096, dtype=np.uint64)) | _U(1)


def _places(n: int) -> np.ndarray:
    return _PLACES[:n] if n <= len(_PLACES) else mix(np.arange(n, dtype=np.uint64)) | _U(1)


class Words(NamedTuple):
    start: np.ndarray  # first byte in the data
    length: np.ndarray  # bytes
    doc: np.ndarray  # row of the text
    hash: np.ndarray  # uint64
    bounds: np.ndarray  # n+1: the words of row i are bounds[i]:bounds[i+1]


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> Words:
    """The words of the texts data[offs[i]:offs[i+1]]."""
    n = len(offs) - 1
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = np.flatnonzero(offs[:-1] < offs[1:])
    head, tail = offs[full], offs[full + 1] - 1
    first[head], last[tail] = solid[head], solid[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    length = end - start
    doc = np.searchsorted(offs, start, "right") - 1
    bounds = np.searchsorted(doc, np.arange(n + 1))
    if not len(start):
        return Words(start, length, doc, np.zeros(0, np.uint64), bounds)
    begin = np.cumsum(length) - length
    place = np.arange(begin[-1] + length[-1]) - np.repeat(begin, length)
    body = data[solid]
    body = (LOWER[body] if lower else body).astype(np.uint64) + _U(1)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(body * _places(int(length.max()))[place], begin)
    return Words(start, length, doc, mix(h), bounds)


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles, sorted by row, then hash; a text of fewer words is one shingle."""
    n = len(w.bounds) - 1
    count = np.diff(w.bounds)
    mult = mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
    with np.errstate(over="ignore"):
        total = len(w.hash)
        if total >= k:
            h = np.zeros(total - k + 1, np.uint64)
            for i in range(k):
                h += mix(w.hash[i : total - k + 1 + i] ^ mult[i])
            same = w.doc[: total - k + 1] == w.doc[k - 1 :]
            doc, h = w.doc[: total - k + 1][same], mix(h[same])
        else:
            doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            place = np.arange(total) - w.bounds[w.doc]
            part = mix(w.hash ^ mult[np.minimum(place, k - 1)])
            sums = np.add.reduceat(part, w.bounds[few]) if len(few) == n else np.array([part[w.bounds[i] : w.bounds[i + 1]].sum() for i in few], np.uint64)
            doc, h = np.concatenate([doc, few]), np.concatenate([h, mix(sums + count[few].astype(np.uint64))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
