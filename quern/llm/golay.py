"""The binary Golay code [23, 12, 7] as a fuzzy hash.

The code is perfect: every 23-bit word lies within 3 bits of exactly one codeword. A word's keys are the indices of
the codewords that it and its 23 neighbours at one bit decode to: one key for words within 2 bits of their
codeword, six for the others. Two words that differ in one bit share a key by construction (either is among the
neighbours of the other).
"""

from __future__ import annotations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, PARITY = 23, 11


def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.uint32).copy()
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        rest ^= np.where(rest >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - PARITY)), np.uint32(0))
    return rest


def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes by byte of a word, and the error of each of the 2048 syndromes."""
    by_byte = [_remainder(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) & np.uint32((1 << LENGTH) - 1)) for k in range(3)]
    single = [1 << i for i in range(LENGTH)]
    errors = {0, *single}
    errors |= {a | b for a in single for b in single}
    errors |= {a | b | c for a in single for b in single for c in single}
    patterns = np.array(sorted(errors), dtype=np.uint32)
    table = np.zeros(1 << PARITY, dtype=np.uint32)
    table[_remainder(patterns)] = patterns
    return by_byte, table


_BYTES, _ERRORS = _tables()
_FLIPS = np.array([0] + [1 << i for i in range(LENGTH)], dtype=np.uint32)


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    w = words.astype(np.uint32)
    syndrome = _BYTES[0][w & 255] ^ _BYTES[1][w >> 8 & 255] ^ _BYTES[2][w >> 16]
    return (w ^ _ERRORS[syndrome]) >> np.uint32(PARITY)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid) of shape (n, 6): the distinct keys of each word come first in its row."""
    if not len(words):
        return np.zeros((0, 6), np.uint32), np.zeros((0, 6), bool)
    found = np.sort(decode(words[:, None].astype(np.uint32) ^ _FLIPS[None, :]), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    order = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(new, order, axis=1)
