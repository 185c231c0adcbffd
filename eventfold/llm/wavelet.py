"""A wavelet matrix over small symbols, for many positions at a time."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bits with a count of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Symbols of ``depth`` bits, one level for each bit from the highest down.

    A level holds its bit of all symbols, then sorts them by it, order kept; so the symbols
    that begin with the same bits stand together, and a rank needs one count a level.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.levels = depth, []
        for level in range(depth - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, at: np.ndarray, bits: int | None = None) -> np.ndarray:
        """How often ``symbol`` stands in front of each position.

        With ``bits`` only the highest that many are compared, ``symbol`` being those.
        """
        bits = bits or self.depth
        low, high = np.zeros_like(at), at
        for level, held in enumerate(self.levels[:bits]):
            ones_low, ones_high = held.ones(low), held.ones(high)
            if symbol >> (bits - 1 - level) & 1:
                low, high = held.zeros + ones_low, held.zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low
