"""A compressed FM-index over short passages of hashed words, searched for many passages at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of symbols: one packed bit row per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.rows, n = [], len(symbols)
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.rows.append((level, words, before, n - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position ends up; the difference to that of position 0 is the rank of the symbol."""
        for level, words, before, zeros in self.rows:
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(words[block] & below)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches whose length is a power of two."""
    out, step = [values], 1
    while 2 * step <= len(values):
        last = out[-1]
        out.append(np.minimum(last[:-step], last[step:]))
        step *= 2
    return out


class FMIndex:
    """Index of passages, each with an owner; finds how far texts match passages of smaller owners."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> None:
        m, n = len(lengths), len(words) + len(lengths)
        self.n, self.m = n, m
        self.known, codes = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1  # each passage ends in a separator of its own, below all words
        text = np.empty(n, np.int64)
        text[ends] = np.arange(m)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = codes + m
        order, common = self._suffixes(text)
        symbol = np.where(text < m, 0, text - m + 1)
        bits = max(1, int(len(self.known)).bit_length())
        self.bwt = WaveletMatrix(symbol[order - 1], bits)
        counts = np.bincount(codes, minlength=len(self.known))
        self.first = np.concatenate([[0], m + np.cumsum(counts) - counts])
        all_symbols = np.arange(len(self.known) + 1)
        self.origin = self.bwt.descend(all_symbols, np.zeros(len(all_symbols), np.int64))
        self.common = _minima(common)
        owner = np.repeat(owners, lengths + 1)
        self.owner = _minima(owner[order])

    @staticmethod
    def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by doubling, and common prefix lengths of neighbours (-1 at both ends)."""
        n, step, rank = len(text), 1, text
        ranks = [rank]
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            values, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
            ranks.append(rank)
            if len(values) == n:
                break
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        left, right = order[:-1].copy(), order[1:].copy()
        length = np.zeros(n - 1, np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            a, b = left + length, right + length
            inside = (a < n) & (b < n)
            same = inside.copy()
            same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
            length[same] += 1 << level
        return order, np.concatenate([[-1], length, [-1]]).astype(np.int32)

    def _lowest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), self.owner[0].dtype)
        for k in np.unique(level):
            pick = level == k
            row = self.owner[k]
            out[pick] = np.minimum(row[low[pick]], row[high[pick] - (1 << int(k))])
        return out

    def _parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The enclosing interval of the next shorter match, and its length."""
        rows = self.common
        depth = np.maximum(rows[0][low], rows[0][high])
        low, high = low.copy(), high.copy()
        for k in range(len(rows) - 1, -1, -1):
            step, row = 1 << k, rows[k]
            at = low - step + 1
            go = at >= 0
            go[go] = row[at[go]] >= depth[go]
            low[go] -= step
            go = high < len(row)
            go[go] = row[high[go]] >= depth[go]
            high[go] += step
        return low, high, np.maximum(depth, 0)

    def matching_statistics(self, passages: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """For each position of each passage (rows, padded), the longest match with a smaller owner.

        Backward search goes right to left through all passages in step; where a match
        can't be extended it is shortened to the next length that other text shares.
        """
        out = np.zeros(passages.shape, np.int16)
        code = np.searchsorted(self.known, passages)
        code[code == len(self.known)] = 0
        code = np.where(self.known[code] == passages, code + 1, 0) if len(self.known) else np.zeros_like(code)
        live = np.flatnonzero(lengths > 0)
        at, length = lengths[live].astype(np.int64), np.zeros(len(live), np.int64)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        while len(live):
            symbol = code[live, at - 1]
            both = self.bwt.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            base = self.first[symbol] - self.origin[symbol]
            new_low, new_high = both[: len(live)] + base, both[len(live) :] + base
            fits = (new_low < new_high) & (symbol > 0)
            fits[fits] = self._lowest_owner(new_low[fits], new_high[fits]) < owners[live[fits]]
            low[fits], high[fits] = new_low[fits], new_high[fits]
            length[fits] += 1
            absent = ~fits & (length == 0)
            shorter = ~fits & (length > 0)
            if shorter.any():
                low[shorter], high[shorter], length[shorter] = self._parent(low[shorter], high[shorter])
            moved = fits | absent
            at[moved] -= 1
            out[live[moved], at[moved]] = length[moved]
            stay = at > 0
            if not stay.all():
                live, at, length, low, high = live[stay], at[stay], length[stay], low[stay], high[stay]
        return out
