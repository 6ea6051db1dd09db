"""Elias-Fano sequences and a two-level n-gram trie over them."""

from __future__ import annotations

import os
import tempfile

import numpy as np

WORD = 21  # bits of a successor's number inside its context
STEPS = 256  # quantisation steps per decade of probability
U64 = np.uint64


class Sequence:
    """A non-decreasing sequence of 64-bit values: low bits packed side by side,
    high bits as unary gaps. Access and successor search work on arrays of queries."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.l, self.low = n, low_bits, low
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[:n]
        self.highs = (ones - np.arange(n)).astype(np.uint32)  # monotone high parts
        top = int(self.highs[-1]) + 2 if n else 1
        self.first = np.searchsorted(self.highs, np.arange(top + 1)).astype(np.uint32)  # start of each high part

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        """[n and low bits, packed low bits, high bits] of sorted values."""
        v = values.astype(U64)
        n = len(v)
        l = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        i = np.arange(n, dtype=U64)
        high = np.zeros((int(v[-1] >> U64(l)) + n) // 8 + 1 if n else 1, np.uint8)
        at = (v >> U64(l)) + i
        np.bitwise_or.at(high, (at >> U64(3)).astype(np.int64), np.left_shift(1, (at & U64(7)).astype(np.uint8)).astype(np.uint8))
        low = np.zeros(n * l // 64 + 2, U64)
        if l:
            bits, pos = v & U64((1 << l) - 1), i * U64(l)
            word, shift = (pos >> U64(6)).astype(np.int64), pos & U64(63)
            np.bitwise_or.at(low, word, bits << shift)
            over = shift + U64(l) > U64(64)
            np.bitwise_or.at(low, word[over] + 1, bits[over] >> (U64(64) - shift[over]))
        return [np.array([n, l], U64), low, high]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U64)
        pos = i.astype(U64) * U64(self.l)
        word, shift = (pos >> U64(6)).astype(np.int64), pos & U64(63)
        wide = self.low[word] >> shift
        over = shift + U64(self.l) > U64(64)
        wide[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return wide & U64((1 << self.l) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.highs[i].astype(U64) << U64(self.l) | self._lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value >= x; n where there is none."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        h = np.minimum(x >> U64(self.l), U64(len(self.first) - 2)).astype(np.int64)
        lo, hi = self.first[h].astype(np.int64), self.first[h + 1].astype(np.int64)
        beyond = x >> U64(self.l) > U64(int(self.highs[-1]))
        lo[beyond] = hi[beyond] = self.n
        low = x & U64((1 << self.l) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self._lows(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the value, -1 where absent."""
        at = self.successor(x)
        there = at < self.n
        there[there] = self[at[there]] == x[there]
        return np.where(there, at, -1)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65535).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code / -float(STEPS))


def write_trie(context: np.ndarray, word: np.ndarray, p: np.ndarray) -> bytes:
    """Bytes of the trie of (context, word) pairs sorted by both."""
    keys, start = np.unique(context, return_index=True)
    rank = np.repeat(np.arange(len(keys)), np.diff(np.r_[start, len(context)]))
    arrays = [
        *Sequence.encode(keys), *Sequence.encode(np.r_[start, len(context)]),
        *Sequence.encode(rank.astype(U64) << U64(WORD) | word.astype(U64)), quantised(p),
    ]
    sizes = np.array([a.nbytes for a in arrays], U64)
    pad = [a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays]
    return b"".join([sizes.tobytes(), *pad])


class Trie:
    """The trie's bytes, memory-mapped from a file of the task that is removed at once."""

    KINDS = [U64, U64, np.uint8] * 3 + [np.uint16]

    def __init__(self, raw: bytes):
        with tempfile.NamedTemporaryFile(suffix=".trie", delete=False) as f:
            f.write(raw)
        whole = np.memmap(f.name, np.uint8, "r")
        os.unlink(f.name)  # the mapping stays
        sizes = whole[: 8 * len(self.KINDS)].view(U64)
        at, parts = 8 * len(self.KINDS), []
        for size, kind in zip(sizes.tolist(), self.KINDS):
            parts.append(whole[at : at + size].view(kind))
            at += size + -size % 8
        self.keys, self.starts, self.kids = (Sequence(int(parts[i][0]), int(parts[i][1]), parts[i + 1], parts[i + 2]) for i in (0, 3, 6))
        self.codes = parts[9]

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Stored probability of each pair, 0 where the trie has none."""
        node = self.keys.find(context.astype(U64))
        out = np.zeros(len(node))
        on = np.flatnonzero(node >= 0)
        # a successor is searched by its number relative to the context's place
        at = self.kids.find(node[on].astype(U64) << U64(WORD) | word[on].astype(U64))
        hit = at >= 0
        out[on[hit]] = restored(self.codes[at[hit]])
        return out
