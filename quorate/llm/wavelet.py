"""Suffix order and a wavelet matrix over it, for occurrence queries in a word sequence.

Everything works on whole arrays of queries at once. Memory is about eight bytes a word
and binary digit of the sequence's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def prefix_ranks(seq: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, ranks) for the lengths 1, 2, 4 up to ``most``, by prefix doubling.

    The rank of a place is the number of places whose next ``length`` items sort lower,
    so equal factors share a rank and their places form one interval of the suffix
    array that starts there. Only places whose factor is not unique are sorted again.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = seq[order[1:]] != seq[order[:-1]]
    ranks = np.empty(n, np.int64)
    ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    length = 1
    while True:
        yield length, ranks
        if 2 * length > most:
            return
        shared = np.flatnonzero(np.bincount(ranks, minlength=n)[ranks] > 1)
        if not len(shared):
            return
        after = shared + length
        second = np.where(after < n, ranks[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(ranks[shared] * (n + 1) + second, kind="stable")
        first, second = ranks[shared[order]], second[order]
        at = np.arange(len(order))
        group = np.ones(len(order), bool)
        group[1:] = first[1:] != first[:-1]
        fresh = group.copy()
        fresh[1:] |= second[1:] != second[:-1]
        begin = np.maximum.accumulate(np.where(group, at, 0))
        ranks = ranks.copy()
        ranks[shared[order]] = first + np.maximum.accumulate(np.where(fresh, at, 0)) - begin
        length *= 2


class WaveletMatrix:
    """Order statistics of any interval of an array of numbers below ``2 ** bits``."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit) & 1
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - ones, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            picked = ones.astype(bool)
            values = np.concatenate([values[~picked], values[picked]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values in [low, high) are smaller than ``bound``."""
        count = np.zeros(len(low), np.int64)
        for bit, zeros, split in self.levels:
            a, b = zeros[low], zeros[high]
            one = ((bound >> bit) & 1).astype(bool)
            count += np.where(one, b - a, 0)
            low = np.where(one, split + low - a, a)
            high = np.where(one, split + high - b, b)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with ``n`` smaller ones in [low, high), for 0 <= n < high - low."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros, split in self.levels:
            a, b = zeros[low], zeros[high]
            one = n >= b - a
            n = np.where(one, n - (b - a), n)
            value |= one.astype(np.int64) << bit
            low = np.where(one, split + low - a, a)
            high = np.where(one, split + high - b, b)
        return value
