"""An FM-index over a sequence of numbered words, searched for many phrases at once.

Symbol 0 stands for whatever no phrase holds (foreign words, ends of texts).
Every 0 is a separator of its own, so no match crosses one and suffixes differ
at the latest there. The last symbol is a 0.
"""

from __future__ import annotations

import numpy as np

RATE = 16  # every so many suffix positions are sampled, and those after a separator


class Bits:
    """A packed bit sequence with ranks."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        raw = np.zeros(self.n // 64 * 8 + 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


class Wavelet:
    """Ranks of symbols in a sequence, by one bit sequence per binary digit,
    each stably parted by the digits above."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.digits = range(max(1, int(largest).bit_length()) - 1, -1, -1)
        self.levels, self.zeros = [], []
        for digit in self.digits:
            ones = (symbols >> digit & 1).astype(bool)
            self.levels.append(Bits(ones))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
            self.zeros.append(len(ones) - int(self.levels[-1].before[-1]))
        self.first = self._descend(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for digit, bits, zeros in zip(self.digits, self.levels, self.zeros):
            ones = bits.rank(at)
            at = np.where(symbol >> digit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._descend(symbol, at) - self.first[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(at), bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol, at - self.first[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions by suffix; separators are smaller than words and differ from each other.

    Suffixes are sorted by as many symbols as fit a long, then ties alone by
    twice as many symbols a round, with the ranks of the round before."""
    n = len(text)
    foreign = text == 0
    own = np.where(foreign, np.cumsum(foreign) - 1, text + (int(foreign.sum()) - 1))
    bits = max(1, int(own.max()).bit_length())
    depth = min(n, max(1, 62 // bits))
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key <<= bits
        key[: n - i] |= own[i:]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots, key = np.arange(n), key[order]
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        group = slots[new][np.cumsum(new) - 1]
        rank[order[slots]] = group
        tied = ~(new & np.append(new[1:], True))
        slots = slots[tied]
        if not len(slots):
            return order
        part = order[slots]
        key = rank[part] << 32 | rank[part + depth]
        by = np.argsort(key)
        order[slots], key = part[by], key[by]
        depth *= 2


class Index:
    def __init__(self, text: np.ndarray, largest: int):
        """``text`` ends with 0; its symbols are 0 to ``largest``."""
        order = suffix_order(text)
        before = text[order - 1]  # of the first position it is the last symbol, a separator
        self.n = len(text)
        self.ranks = Wavelet(before, largest)
        self.start = np.append(0, np.cumsum(np.bincount(text, minlength=largest + 1))[:-1])
        sampled = (order % RATE == 0) | (before == 0)
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with a symbol before the given ranges' phrases."""
        both = self.ranks.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        low, high = np.split(both, 2)
        return self.start[symbol] + low, self.start[symbol] + high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to the next sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            here = self.sampled.get(rows)
            out[todo[here]] = self.samples[self.sampled.rank(rows[here])] + steps
            todo, rows, steps = todo[~here], rows[~here], steps + 1
            symbol, rank = self.ranks.symbol_and_rank(rows)
            rows = self.start[symbol] + rank
        return out
