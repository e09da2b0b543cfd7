"""Recompression of word sequences: rounds of run and pair compression that name equal substrings alike.

A round names each maximal run of one symbol, then splits the alphabet in two by a hash of the name and names
each pair of a left symbol and a right one after it. A name is a hash of what it stands for, so all tasks
give equal content the same name without a dictionary, and with each symbol goes the interval of words that
decides it: wherever these words occur again, the same symbol occurs. Arrays hold many documents at once; no
symbol crosses from one into the next.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A value for each byte, so that words are sums of these over powers of an odd base.
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _A) ^ (np.arange(1, 257, dtype=np.uint64) * _B >> np.uint64(7))


_WORD_BASE = 0x5851F42D4C957F2D
#: Bytes whose words are hashed together.
BLOCK = 1 << 17
#: Sums over powers of a base modulo 2^64 can be made to collide by words of a thousand bytes; longer ones than this are digested.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit counts."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _times(n: int, by: np.uint64) -> np.uint64:
    return np.uint64(n * int(by) & (1 << 64) - 1)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i below n; base is odd."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words_of(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data (bytes), and the document of each; document i is data[offsets[i]:offsets[i + 1]]."""
    base = _WORD_BASE + 2 * seed
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last[:-1] &= ~inside[1:] | border[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    h, i = np.empty(len(a), np.uint64), 0
    up, down = _powers(base, min(len(data), 2 * BLOCK))
    while i < len(a):  # some words at a time, so that arrays over bytes stay small
        j = max(i + 1, int(np.searchsorted(b, a[i] + BLOCK, side="right")))
        low, size = a[i], int(b[j - 1] - a[i])
        if size > len(up):
            up, down = _powers(base, size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[low : low + size]] * up[:size], out=sums[1:])
        h[i:j] = (sums[b[i:j] - low] - sums[a[i:j] - low]) * down[a[i:j] - low]
        i = j
    for k in np.flatnonzero(b - a > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[a[k] : b[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return mix(h + (b - a).astype(np.uint64) * _B), np.searchsorted(offsets, a, side="right") - 1


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each place; those that don't fit in are left out."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(0xD1342543DE82EF95, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    n = len(words) - size + 1
    return mix((sums[size:] - sums[:-size]) * down[:n])


@dataclass
class Symbols:
    """Symbols in order: name, document, first and last word, and the interval of words that decides each."""

    name: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of_words(words: np.ndarray, doc: np.ndarray) -> Symbols:
        at = np.arange(len(words))
        return Symbols(words, doc, at, at, at, at)

    def _sides(self) -> tuple[np.ndarray, np.ndarray]:
        """What the neighbours are decided by; beside a document's edge, a word outside of it."""
        same = self.doc[1:] == self.doc[:-1]
        left, right = self.start - 1, self.end + 1
        left[1:] = np.where(same, self.low[:-1], left[1:])
        right[:-1] = np.where(same, self.high[1:], right[:-1])
        return left, right

    def runs(self, tag: int) -> Symbols:
        """Maximal runs of one symbol become one; a symbol stays single because both neighbours differ from it."""
        n = len(self.name)
        if not n:
            return self
        left, right = self._sides()
        new = np.ones(n, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        size = last - first + 1
        name = np.where(size > 1, mix(self.name[first] + size.astype(np.uint64) * _B + np.uint64(tag)), self.name[first])
        return Symbols(name, self.doc[first], self.start[first], self.end[last], np.minimum(self.low[first], left[first]), np.maximum(self.high[last], right[last]))

    def pairs(self, tag: int) -> Symbols:
        """A left symbol and a right one after it become one; any other depends on the neighbour it might have joined."""
        n = len(self.name)
        if n < 2:
            return self
        is_right = mix(self.name + _times(tag, _A)) & np.uint64(1) == 1
        joins = np.zeros(n, bool)  # with the next one
        joins[:-1] = ~is_right[:-1] & is_right[1:] & (self.doc[1:] == self.doc[:-1])
        joined = np.zeros(n, bool)
        joined[1:] = joins[:-1]
        left, right = self._sides()
        low = np.where(is_right & ~joined, np.minimum(self.low, left), self.low)
        high = np.where(~is_right & ~joins, np.maximum(self.high, right), self.high)
        keep = np.flatnonzero(~joined)
        then = np.minimum(keep + 1, n - 1)
        two = joins[keep]
        pick = lambda one, other: np.where(two, other[then], one[keep])
        name = np.where(two, mix(self.name[keep] * _B + self.name[then] + np.uint64(tag)), self.name[keep])
        return Symbols(name, self.doc[keep], self.start[keep], pick(self.end, self.end), np.minimum(low[keep], pick(low, low)), np.maximum(high[keep], pick(high, high)))


def rounds_for(window: int) -> int:
    """As many rounds as leave symbols that a window of this many words decides twice over."""
    rounds, reach, size = 1, 4.0, 4 / 3
    while reach + 3 * size <= window / 2:
        rounds, reach, size = rounds + 1, reach + 3 * size, size * 4 / 3
    return rounds


def anchors(words: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window (by its first word): whether it lies in one document, and the name and first word of its anchor.

    The anchor is the symbol of the highest round that the window's words decide; of several the one with the
    lowest name, then the leftmost. So windows of equal words have equal anchors at equal distance.
    """
    n = max(0, len(words) - window + 1)
    inside = doc[:n] == doc[window - 1 :] if n else np.zeros(0, bool)
    name, start, open_ = np.zeros(n, np.uint64), np.zeros(n, np.int64), inside.copy()
    levels = [Symbols.of_words(words, doc)]
    for k in range(rounds_for(window)):
        levels.append(levels[-1].runs(2 * k + 1).pairs(2 * k + 2))
    for k in range(len(levels) - 1, -1, -1):
        s, p = levels[k], np.flatnonzero(open_)
        if not len(p):
            break
        rank = mix(s.name + _times(k + 1, _B))
        low = np.searchsorted(s.low, p)  # the first symbol decided from p on; low and high grow along the symbols
        high = np.searchsorted(s.high, p + window - 1, side="right") - 1
        has = low <= high
        p, low, high = p[has], low[has], high[has]
        if not len(p):
            continue
        best = low.copy()
        for d in range(1, int((high - low).max()) + 1):
            other = np.minimum(low + d, high)
            best = np.where(rank[other] < rank[best], other, best)
        name[p], start[p], open_[p] = rank[best], s.start[best], False
    return inside, name, start
