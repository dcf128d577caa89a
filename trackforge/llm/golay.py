"""The perfect binary Golay code of length 23: every word is within three bits of exactly one codeword.

A codeword is named by its twelve information bits. Words that differ in two bits at most have a word between them that
differs from both in one; so the codewords that the one-bit surroundings of both decode to have one in common.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
GENERATOR = 0b101011100011  # fixed value: the generator polynomial of the code


@functools.cache
def bit_syndromes() -> np.ndarray:
    """Remainder of x**i by the generator, for each place of a word."""
    out, value = [], 1
    for _ in range(LENGTH):
        out.append(value)
        value <<= 1
        if value >> CHECKS:
            value ^= GENERATOR
    return np.array(out, np.uint32)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the lower eleven and of the upper twelve bits of a word; the error of at most three bits for each syndrome."""

    def spanned(values: np.ndarray) -> np.ndarray:
        table = np.zeros(1, np.uint32)
        for v in values:
            table = np.concatenate([table, table ^ v])
        return table

    bits = bit_syndromes()
    errors = np.zeros(1 << CHECKS, np.uint32)
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            errors[np.bitwise_xor.reduce(bits[list(places)])] = sum(1 << i for i in places)
    return spanned(bits[:CHECKS]), spanned(bits[CHECKS:]), errors


def syndromes(words: np.ndarray) -> np.ndarray:
    low, high, _ = _tables()
    return low[words & ((1 << CHECKS) - 1)] ^ high[words >> CHECKS]


def nearest(words: np.ndarray) -> np.ndarray:
    """Name of the codeword next to each word."""
    return (words ^ _tables()[2][syndromes(words)]) >> CHECKS


def surrounding(words: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """Names of the codewords next to each word and to those that differ from it in one of the lower width bits.

    A column for each word; row 0 has the word's own codeword.
    """
    errors, own = _tables()[2], syndromes(words)
    flips = np.concatenate([[0], np.uint32(1) << np.arange(width, dtype=np.uint32)]).astype(np.uint32)[:, None]
    moved = np.concatenate([[0], bit_syndromes()[:width]]).astype(np.uint32)[:, None]
    return (words ^ flips ^ errors[own ^ moved]) >> CHECKS
