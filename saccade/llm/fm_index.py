"""A compressed FM-index over word sequences: succinct wavelet matrix of the Burrows-Wheeler transform, capped LCP bytes.

What stays after the construction: the bits of the wavelet matrix with their counts, the counts of the symbols, one byte of LCP a position
(capped at the depth of the index) with its tree of minima, one bit a position for the groups of suffixes that share ``depth``
symbols, and a value per group. Texts, suffixes and ranks do not.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed in 64-bit words with a count per word; rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.shifts = range(max(top, 1).bit_length() - 1, -1, -1)
        self.levels, left = [], symbols
        for shift in self.shifts:
            bits = (left >> shift) & 1 == 1
            self.levels.append(BitVector(bits))
            left = np.concatenate([left[~bits], left[bits]])
        # where each symbol's block begins after the last level
        self.begin = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64)).astype(np.int32)

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level in zip(self.shifts, self.levels, strict=True):
            ones = level.rank(at)
            at = np.where((symbols >> shift) & 1 == 1, level.zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(symbols, at) - self.begin[symbols]


class MinTree:
    """Bytes with minima over pairs, pairs of pairs, ...: the nearest smaller value to either side in logarithmic time."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1:
            last = self.levels[-1]
            even = np.append(last, np.uint8(255)) if len(last) % 2 else last
            self.levels.append(even.reshape(-1, 2).min(1))

    def nearest(self, at: np.ndarray, below: np.ndarray, step: int) -> np.ndarray:
        """The first position from at on, to the left (step -1) or right (1), whose value is less than below. There is one."""
        at, found = at.copy(), np.full(len(at), -1)
        open_ = np.arange(len(at))
        first = 0 if step > 0 else 1  # the child that comes first in this direction
        for level, values in enumerate(self.levels):
            hit = values[at[open_]] < below[open_]
            found[open_[hit]] = level
            open_ = open_[~hit]
            sibling = open_[at[open_] % 2 == first]
            rest = open_[at[open_] % 2 != first]
            at[sibling] += step
            hit = values[at[sibling]] < below[sibling]
            found[sibling[hit]] = level
            open_ = np.concatenate([rest, sibling[~hit]])
            if not len(open_):
                break
            at[open_] = (at[open_] + step) >> 1
        for level in range(int(found.max(initial=0)) - 1, -1, -1):
            down, values = np.flatnonzero(found > level), self.levels[level]
            child = 2 * at[down] + first
            good = child < len(values)
            good[good] = values[child[good]] < below[down[good]]
            at[down] = np.where(good, child, 2 * at[down] + 1 - first)
        return at


class FMIndex:
    """Index of segments (arrays of word hashes), each with a value; matches are found up to depth words.

    Symbols: 0 to len(segments)-1 end the segments, so no match crosses them; words follow in the order of their hashes. Suffixes are
    sorted by their first symbols only, as many as depth needs. Matching statistics come from backward search, from right to left.
    """

    def __init__(self, segments: list[np.ndarray], values: np.ndarray, depth: int):
        lengths = np.array([len(s) for s in segments], np.int64)
        words = np.concatenate(segments) if segments else np.empty(0, np.uint64)
        self.alphabet, ids = np.unique(words, return_inverse=True)
        self.segments, self.depth = len(segments), depth
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(len(words) + self.segments, np.int64)
        text[ends] = np.arange(self.segments)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = ids + self.segments
        self.size = len(text)
        top = self.segments + len(self.alphabet) - 1
        order, ranks = self._sort(text, depth)
        common = self._common(order, ranks)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int32)
        self.wavelet = WaveletMatrix(text[order - 1], top)
        self.lcp = MinTree(common)
        starts = common[:-1] < depth
        self.groups = BitVector(starts)
        owner = np.repeat(np.arange(self.segments), lengths + 1)[order]
        self.least = np.minimum.reduceat(values[owner], np.flatnonzero(starts)) if self.size else values[:0]

    @staticmethod
    def _sort(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Order of the suffixes by at least depth symbols, by prefix doubling, and their ranks by 1, 2, 4, ... symbols."""
        n, rank, step, ranks = len(text), text, 1, [text]
        order = np.argsort(text, kind="stable")
        while n and step < depth:
            following = np.zeros(n, np.int64)
            following[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (int(following.max()) + 1) + following
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, step = new, step * 2
            ranks.append(rank)
            if rank[order[-1]] == n - 1:
                break
        return order, ranks

    def _common(self, order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """lcp[i]: symbols that suffixes i-1 and i have in common, depth at most; 0 at both ends."""
        n = self.size
        out = np.zeros(n + 1, np.uint8)
        if n > 1:
            a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
            for level in range(len(ranks) - 1, -1, -1):
                inside = (a < n) & (b < n)
                same = np.zeros(n - 1, bool)
                same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
                jump = same.astype(np.int64) << level
                a, b, common = a + jump, b + jump, common + jump
            out[1:n] = np.minimum(common, self.depth)
        return out

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes, -1 for words that the index does not have."""
        if not len(self.alphabet):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + self.segments, -1)

    def _extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.maximum(symbols, 0)
        both = self.wavelet.rank(np.concatenate([known, known]), np.concatenate([lo, hi]))
        a, b = self.first[known] + both[: len(known)], self.first[known] + both[len(known) :]
        return np.where(symbols < 0, 0, a), np.where(symbols < 0, 0, b)

    def _parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval, of a shorter match, and its length."""
        depth = np.maximum(self.lcp.levels[0][lo], self.lcp.levels[0][hi])
        wide = depth > 0
        low, high = np.zeros(len(lo), np.int64), np.full(len(hi), self.size, np.int64)
        low[wide] = self.lcp.nearest(lo[wide], depth[wide], -1)
        high[wide] = self.lcp.nearest(hi[wide], depth[wide], 1)
        return low, high, depth.astype(np.int64)

    def value(self, low: np.ndarray) -> np.ndarray:
        """The smallest value of the segments in the intervals of matches of depth words, given where these begin."""
        return self.least[self.groups.rank(low)]

    def matching_statistics(self, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and position (queries by positions, right-aligned): match length up to depth, and its interval.

        All queries take their steps together. When a step to the left fails, the match is shortened from the right to
        the next interval above, until the step succeeds or nothing is left.
        """
        longest, n, cap = max(map(len, queries), default=0), self.size, self.depth
        grid = np.full((len(queries), longest), -1, np.int64)
        sizes = np.array([len(q) for q in queries], np.int64)
        used = np.arange(longest)[None, :] >= (longest - sizes)[:, None]
        grid[used] = self.symbols(np.concatenate(queries)) if queries else np.empty(0, np.int64)
        length = np.zeros((len(queries), longest), np.int32)
        low, high = np.zeros((len(queries), longest), np.int32), np.full((len(queries), longest), n, np.int32)
        lo, hi, size = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64), np.zeros(len(queries), np.int64)
        for p in range(longest - 1, -1, -1):
            todo = here = np.flatnonzero(used[:, p])
            while len(todo):
                a, b = self._extend(grid[todo, p], lo[todo], hi[todo])
                good = b > a
                done, stuck = todo[good], todo[~good]
                lo[done], hi[done] = a[good], b[good]
                size[done] += 1
                empty = stuck[size[stuck] == 0]
                lo[empty], hi[empty] = 0, n
                todo = stuck[size[stuck] > 0]
                if len(todo):
                    lo[todo], hi[todo], size[todo] = self._parent(lo[todo], hi[todo])
            over = np.flatnonzero(size > cap)
            if len(over):
                most = np.full(len(over), cap, np.uint8)
                lo[over], hi[over], size[over] = self.lcp.nearest(lo[over], most, -1), self.lcp.nearest(lo[over] + 1, most, 1), cap
            length[here, p], low[here, p], high[here, p] = size[here], lo[here], hi[here]
        return length, low, high
