"""A compressed FM-index over word numbers: suffix array, Burrows-Wheeler transform, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class _Bits:
    """A bit vector with rank: 64 bits a word and a count before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        size = len(bits) // 64 + 1
        padded = np.zeros(size * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Over texts of numbers from 1 on; matches never span two texts."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        n = sum(map(len, texts)) + len(texts)
        symbols = np.zeros(n, np.int64)
        at, gaps = 0, np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            symbols[at : at + len(t)] = t
            at += len(t) + 1
            gaps[k] = at - 1
        order = self._suffixes(symbols, gaps)
        last = symbols[order - 1]  # of the first text's first suffix: the last gap, which is 0 too
        top = int(symbols.max(initial=0))
        self.starts = np.searchsorted(symbols[order], np.arange(top + 2))
        self.levels = max(1, top.bit_length())
        self.bits: list[_Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level) & 1
            self.bits.append(_Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        every = np.arange(top + 1)
        self.origin = np.zeros(top + 1, np.int64)
        self.origin = self._descend(every, np.zeros(top + 1, np.int64))

    @staticmethod
    def _suffixes(symbols: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Suffix array by doubling. Every gap sorts as a symbol of its own, so that suffixes differ within their text."""
        n = len(symbols)
        rank = symbols + len(gaps)
        rank[gaps] = np.arange(len(gaps))
        order = np.argsort(rank, kind="stable")
        width = 1
        while True:
            sorted_ = rank[order]
            new = np.zeros(n, np.int64)
            if width == 1:
                new[1:] = np.cumsum(sorted_[1:] != sorted_[:-1])
            else:
                new[1:] = np.cumsum(key[order][1:] != key[order][:-1])  # noqa: F821
            rank = np.empty(n, np.int64)
            rank[order] = new
            if not n or new[-1] == n - 1:
                return order
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            width *= 2

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often a symbol is among the first `at` of the transform."""
        return self._descend(symbol, at) - self.origin[symbol]

    def statistics(self, text: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> np.ndarray:
        """Matching statistics: for each end (a position in text, exclusive) the length of the longest run of symbols that
        ends there and occurs `least` times or more in the index, at most `most`. text must reach back as far."""
        out = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        low, high = self.starts[text[ends - 1]], self.starts[text[ends - 1] + 1]
        for length in range(1, most + 1):
            good = high - low >= least
            alive, low, high = alive[good], low[good], high[good]
            out[alive] = length
            if length == most or not len(alive):
                break
            symbol = text[ends[alive] - length - 1]
            both = self.rank(np.r_[symbol, symbol], np.r_[low, high])
            low, high = self.starts[symbol] + both[: len(symbol)], self.starts[symbol] + both[len(symbol) :]
        return out

    def covered(self, text: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, least: np.ndarray) -> np.ndarray:
        """For each position of text, whether the window that starts there lies in one of the runs text[first:last] and occurs
        as often as the run asks for. All runs are searched at once: each from its end backward, as long as what was read
        occurs often enough. That gives a maximal match and all windows in it, and the search goes on at the last end of a
        window that begins before the match. After a match that is shorter than a window a few symbols around its beginning
        are looked up first: where they are too rare by themselves, no window that holds them is left to try."""
        edge = np.zeros(len(text) + 1, np.int64)
        few = max(2, window // 4)
        alive = last - first >= window
        first, end, least = first[alive], last[alive].copy(), least[alive]
        at, low, high = end.copy(), np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        probe, back, stop = np.zeros(len(end), bool), end.copy(), first.copy()  # while probing: the end before, and where it is over
        while len(at):
            symbol = text[at - 1]
            a, b = self.starts[symbol], self.starts[symbol + 1]
            old = np.flatnonzero(at < end)
            if len(old):
                s = symbol[old]
                both = self.rank(np.concatenate([s, s]), np.concatenate([low[old], high[old]]))
                a[old], b[old] = self.starts[s] + both[: len(s)], self.starts[s] + both[len(s) :]
            low, high = a, b
            good = high - low >= least
            at = at - good
            over = ~good | (at == stop)
            if not over.any():
                continue
            whole = over & good & ~probe
            found = over & ~probe & (end - at >= window)
            np.add.at(edge, at[found], 1)
            np.add.at(edge, end[found] - window + 1, -1)
            start = over & ~probe & ~found & (end - at > few)
            new = np.where(found, at + window - 1, np.where(probe, np.where(good, back, end) - 1, end - 1))
            back, stop = np.where(start, end, back), np.where(start, at - 1, np.where(over, first, stop))
            end = np.where(start, at + few - 1, np.where(over, new, end))
            at, probe = np.where(over, end, at), np.where(over, start, probe)
            keep = ~whole & (probe | (end - first >= window))
            if not keep.all():
                first, end, at, low, high, least, probe, back, stop = (x[keep] for x in (first, end, at, low, high, least, probe, back, stop))
        return np.cumsum(edge)[:-1] > 0
