"""FM-index of a sequence of whole numbers: wavelet-matrix ranks, backward search, sampled positions.

Everything works on whole arrays of queries, so one call answers all phrases of a shard.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector with ranks: 64-bit words and a running count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place ``i``."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask).astype(np.int64)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.n = len(symbols)
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            self.levels.append((shift, Bits(bits), int(self.n - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before place ``i``."""
        low = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def take(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each place, and how often it stands before."""
        symbol, low = np.zeros_like(i), np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i) == 1
            symbol |= one.astype(np.int64) << shift
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return symbol, i - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; only unresolved suffixes are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_text = text[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]]))
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    step = 1
    todo = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(todo):
        after = todo + step
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        full = rank[todo] * (n + 2) + key
        by = np.argsort(full, kind="stable")
        full, todo = full[by], todo[by]
        base = rank[todo]
        new_group = np.concatenate([[True], base[1:] != base[:-1]])
        group_head = np.flatnonzero(new_group)
        within = np.arange(len(todo)) - np.repeat(group_head, np.diff(np.append(group_head, len(todo))))
        new_key = np.concatenate([[True], full[1:] != full[:-1]])
        key_head = np.flatnonzero(new_key)
        lengths = np.diff(np.append(key_head, len(todo)))
        rank[todo] = base + np.repeat(within[key_head], lengths)
        todo = todo[np.repeat(lengths, lengths) > 1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Index of ``text`` (whole numbers from 1 on). Every ``rate``-th position is kept."""

    def __init__(self, text: np.ndarray, rate: int = 16):
        text = np.append(text.astype(np.int64), 0)
        order = suffix_order(text)
        last = text[order - 1]
        self.top = int(text.max())
        counts = np.bincount(text, minlength=self.top + 2)
        self.less = np.concatenate([[0], np.cumsum(counts)])[: self.top + 2]
        self.ranks = WaveletMatrix(last, self.top)
        kept = order % rate == 0
        self.marks, self.samples = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (rows of a padded matrix)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.ranks.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= back) & (high > low))
            if not len(on):
                break
            symbol = patterns[on, lengths[on] - back]
            there = (symbol > 0) & (symbol <= self.top)
            high[on[~there]] = low[on[~there]]
            on, symbol = on[there], symbol[there]
            low[on] = self.less[symbol] + self.ranks.rank(symbol, low[on])
            high[on] = self.less[symbol] + self.ranks.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: steps back to a sampled one."""
        rows = rows.copy()
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            here = rows[todo]
            hit = self.marks.get(here) == 1
            out[todo[hit]] = self.samples[self.marks.rank(here[hit])] + steps
            todo, here = todo[~hit], here[~hit]
            symbol, before = self.ranks.take(here)
            rows[todo] = self.less[symbol] + before
            steps += 1
        return out
