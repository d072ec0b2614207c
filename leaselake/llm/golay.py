"""The binary Golay code of length 23 as a fuzzy hash: decoding sends nearby words to the same codeword."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LENGTH = 23
DATA_BITS = 12
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the code.
GENERATOR = 0b101011100011


def _remainders() -> np.ndarray:
    """Remainder by the generator of every single-bit word."""
    out = []
    for place in range(LENGTH):
        value = 1 << place
        for bit in range(LENGTH - 1, 10, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - 11)
        out.append(value)
    return np.array(out, dtype=np.int32)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high half of a word, and the error of each syndrome.

    The code is perfect: the words of at most three bits have 2,048 different syndromes, all there are.
    """
    single = _remainders()

    def span(bits: range) -> np.ndarray:
        table = np.zeros(1, dtype=np.int32)
        for place in bits:
            table = np.concatenate([table, table ^ single[place]])
        return table

    error = np.zeros(1 << 11, dtype=np.int32)
    for a in range(LENGTH):
        for b in range(a, LENGTH):
            for c in range(b, LENGTH):
                word = {a, b, c}
                syndrome = value = 0
                for place in word:
                    syndrome ^= int(single[place])
                    value |= 1 << place
                error[syndrome] = value
    return span(range(12)), span(range(12, LENGTH)), error


def syndrome(words: np.ndarray) -> np.ndarray:
    low, high, _ = _tables()
    return low[words & 0xFFF] ^ high[words >> 12]


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4,095) of the only codeword within three bits of each 23-bit word."""
    return (words ^ _tables()[2][syndrome(words)]) >> 11


def nearby(words: np.ndarray) -> np.ndarray:
    """Indices for each word and its 23 neighbours, one row per word; the first is the word's own.

    Two words at most one bit apart: the own index of either is among the indices of the other. A word two
    bits or less from its codeword has one index, any other has six.
    """
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(words.dtype)
    return decode(words[:, None] ^ flips)
