"""A compressed index of short texts: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np



class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low).astype(np.int64)


class WaveletMatrix:
    """Symbols below ``size`` as one row of bits for each binary digit, highest first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.rows: list[tuple[int, Bits, int]] = []
        for digit in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> digit) & 1
            zeros = int(len(bits) - bits.sum())
            self.rows.append((digit, Bits(bits), zeros))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        # where each symbol begins after the last digit
        self.first = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for digit, bits, zeros in self.rows:
            ones = bits.ones(at)
            at = np.where((symbol >> digit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``at`` ones."""
        return self._down(symbol, at) - self.first[symbol]


def ranked(values: np.ndarray) -> np.ndarray:
    """Ranks from 1 on; equal values share one."""
    return np.unique(values, return_inverse=True)[1].reshape(-1) + 1


class FMIndex:
    """Texts of symbols from 1 on, searched backwards for strings of up to ``depth`` symbols.

    ``flat`` has the texts one after the other, ``sizes`` their lengths. Suffixes are sorted
    by their first ``depth`` symbols, which is as much as the search reads.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, depth: int):
        self.depth = depth
        ends = np.cumsum(sizes)
        text = np.insert(flat, ends, 0)  # a 0 ends each text
        self.text_of = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.n = n = len(text)
        self.size = int(text.max()) + 1 if n else 1

        def later(ranks: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: n - k] = ranks[k:] if k < n else 0
            return out

        ranks, have = {1: text + 1}, 1
        while have < depth:
            step = min(have, depth - have)
            ranks[have + step] = ranked(ranks[have] * (n + self.size + 2) + later(ranks[have], step))
            have += step
        self.rows = np.argsort(ranks[depth], kind="stable")
        self.shared = np.zeros(n, np.uint8)  # symbols that a row shares with the one before, at most depth
        powers = sorted(ranks)
        for d in range(1, depth + 1):
            k = max(p for p in powers if p <= d)
            one, two = ranks[k][self.rows], later(ranks[k], d - k)[self.rows] if d > k else None
            same = one[1:] == one[:-1]
            if two is not None:
                same &= two[1:] == two[:-1]
            self.shared[1:] += same
        self.wavelets = WaveletMatrix(text[self.rows - 1], self.size)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.size))))
        self._classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def classes(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """For suffixes that share their first ``d`` symbols: the class of each row, and where classes begin."""
        if d not in self._classes:
            new = self.shared < d
            new[:1] = True
            self._classes[d] = (np.cumsum(new, dtype=np.int32) - 1, np.append(np.flatnonzero(new), self.n))
        return self._classes[d]

    def _shortened(self, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that start with the first ``length`` symbols of row ``low``."""
        first, end = np.zeros(len(low), np.int64), np.full(len(low), self.n, np.int64)
        for d in np.unique(length[length > 0]):
            at = np.flatnonzero(length == d)
            row_class, begins = self.classes(int(d))
            own = row_class[low[at]]
            first[at], end[at] = begins[own], begins[own + 1]
        return first, end

    def matching_statistics(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the streamed texts: how many symbols from there on stand somewhere in the index.

        At most ``depth`` of them count. Also a row of the index that starts with them.
        Symbols that the index lacks are 0. Texts advance together, from their ends: a match
        is extended by the symbol before it, and loses symbols at its end until that works.
        """
        length, row = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        order = np.argsort(-sizes, kind="stable")
        last = (np.cumsum(sizes) - 1)[order]
        left = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        have = np.zeros(len(sizes), np.int64)
        for step, n in enumerate(left):
            place = last[:n] - step
            symbol = flat[place]
            have[:n][symbol == 0] = 0
            full = np.flatnonzero(have[:n] == self.depth)
            have[full] -= 1
            low[full], high[full] = self._shortened(low[full], have[full])
            todo = np.flatnonzero(symbol > 0)
            absent = np.flatnonzero(symbol == 0)
            low[absent], high[absent] = 0, self.n
            while len(todo):
                c = symbol[todo]
                begin = self.smaller[c] + self.wavelets.rank(c, low[todo])
                end = self.smaller[c] + self.wavelets.rank(c, high[todo])
                hit = begin < end
                there = todo[hit]
                low[there], high[there] = begin[hit], end[hit]
                have[there] += 1
                todo = todo[~hit]
                alone = todo[have[todo] == 0]  # the symbol itself is not in the index
                low[alone], high[alone] = 0, self.n
                todo = todo[have[todo] > 0]
                have[todo] -= 1
                low[todo], high[todo] = self._shortened(low[todo], have[todo])
            length[place], row[place] = have[:n], low[:n]
        return length, row

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each class of suffixes that share ``depth`` symbols: the smallest of its texts' ``values``."""
        _, begins = self.classes(self.depth)
        return np.minimum.reduceat(values[self.text_of[self.rows]], begins[:-1])
