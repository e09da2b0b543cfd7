"""The binary Golay code of length 23: every 23-bit word is within three bits of exactly one of its 4096 codewords."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 23
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainder of each bit, then by remainder: the error of at most three bits, its weight, the five errors of four bits."""
    rest = []
    for i in range(BITS):
        w = 1 << i
        for k in range(i, 10, -1):
            if w >> k & 1:
                w ^= GENERATOR << (k - 11)
        rest.append(w)
    error, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    four: list[list[int]] = [[] for _ in range(2048)]
    for n in range(1, 5):
        for bits in combinations(range(BITS), n):
            s = e = 0
            for b in bits:
                s ^= rest[b]
                e |= 1 << b
            if n < 4:
                error[s], weight[s] = e, n
            else:
                four[s].append(e)
    more = np.array([x if len(x) == 5 else [0] * 5 for x in four], np.int64)
    return np.array(rest, np.int64), error, weight, more


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords near each word, six columns, and which columns hold one.

    A word within two bits of a codeword has that one; one at three bits has also the five at four bits. Two
    words that differ in two bits or fewer always share an index.
    """
    rest, error, weight, more = tables()
    words = words.astype(np.int64)
    s = np.zeros(len(words), np.int64)
    for i in range(BITS):
        s ^= np.where(words >> i & 1, rest[i], 0)
    codes = np.concatenate([(words ^ error[s])[:, None], words[:, None] ^ more[s]], axis=1)
    held = np.ones(codes.shape, bool)
    held[:, 1:] = (weight[s] == 3)[:, None]
    return codes >> 11, held
