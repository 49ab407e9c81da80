"""A compressed FM-index over integer sequences: packed wavelet matrix, backward search for many patterns at once.

The suffix order is exact for DEPTH symbols, which is all that matching statistics up to DEPTH need.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(c, i) over an array of symbols, a packed bit vector with running counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, seq = [], symbols.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            padded = np.zeros(-(-(len(seq) + 1) // 64) * 64, np.uint8)
            padded[: len(seq)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
            self.levels.append((words, before, len(seq) - int(bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.begin = np.zeros(sigma, np.int64)
        self.begin = self.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position i, for arrays of both."""
        i = i.copy()
        for b, (words, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            w = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[w] + np.bitwise_count(words[w] & below)
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i - self.begin[symbol]


class FMIndex:
    """Index of one concatenated text: sequences over 1..sigma-1, each closed by the separator 0."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = len(text)
        self.depth, self.sigma = depth, sigma
        rank = text.astype(np.int64)
        ranks, width = [rank], 1
        while width <= depth:  # backward search steps to depth + 1 before it is cut back
            # a suffix that reaches the end sorts first; what follows a separator does not matter but is harmless
            follow = np.zeros(n, np.int64)
            follow[:-width] = rank[width:] + 1
            order = np.argsort(rank * (n + sigma + 2) + follow, kind="stable")
            key = (rank * (n + sigma + 2) + follow)[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
            ranks.append(rank)
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.lcp = self._common(ranks)
        self.counts = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))
        self.wavelet = WaveletMatrix(text[self.suffixes - 1], sigma)
        self.parent_low, self.parent_high = self._smaller(self.lcp)
        self.class_start = np.flatnonzero(self.lcp[:-1] < depth)
        self.class_of = np.cumsum(self.lcp[:-1] < depth) - 1
        self.class_end = np.append(self.class_start[1:], n)

    def _common(self, ranks: list[np.ndarray]) -> np.ndarray:
        """Symbols, up to depth, that neighbours in suffix order share; -1 at both ends."""
        n = len(self.suffixes)
        a, b = self.suffixes[:-1].copy(), self.suffixes[1:].copy()
        common = np.zeros(max(0, n - 1), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
            step = np.where(same, 1 << level, 0)
            common, a, b = common + step, a + step, b + step
        return np.concatenate([[-1], np.minimum(common, self.depth), [-1]])

    @staticmethod
    def _smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry the next one to the left and to the right that is smaller: the ends of its parent interval."""
        values, n = lcp.tolist(), len(lcp)
        left, right, stack = [0] * n, [n - 1] * n, []
        for i, x in enumerate(values):
            while stack and values[stack[-1]] > x:
                right[stack.pop()] = i
            # an equal entry to the left has the same parent, so its left end is this one's too
            left[i] = (left[stack[-1]] if values[stack[-1]] == x else stack[-1]) if stack else 0
            stack.append(i)
        # to the right, an entry that is closed by a smaller one closes the equal ones below it at the same place
        return np.array(left, np.int64), np.array(right, np.int64)

    def statistics(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of equally long lanes (rows; symbols outside the index as -1), capped at depth.

        Returns, for each position, the length of the longest match that starts there and the number of the class of
        suffixes that share its first depth symbols (where the length is depth; else -1).
        """
        rows, width = lanes.shape
        length, found = np.zeros((rows, width), np.int32), np.full((rows, width), -1, np.int64)
        low, high = np.zeros(rows, np.int64), np.full(rows, len(self.suffixes), np.int64)
        depth = np.zeros(rows, np.int64)
        for p in range(width - 1, -1, -1):
            symbol = lanes[:, p]
            todo = np.flatnonzero(symbol > 0)
            dead = symbol <= 0
            low[dead], high[dead], depth[dead] = 0, len(self.suffixes), 0
            while len(todo):
                c = symbol[todo]
                ends = self.wavelet.rank(np.append(c, c), np.append(low[todo], high[todo])) + np.append(self.counts[c], self.counts[c])
                a, b = ends[: len(todo)], ends[len(todo) :]
                hit = a < b
                won = todo[hit]
                low[won], high[won], depth[won] = a[hit], b[hit], depth[won] + 1
                todo = todo[~hit]
                top = depth[todo] == 0
                low[todo[top]], high[todo[top]] = 0, len(self.suffixes)
                todo = todo[~top]
                # shorten: the parent interval
                k = np.where(self.lcp[low[todo]] >= self.lcp[high[todo]], low[todo], high[todo])
                depth[todo] = np.maximum(self.lcp[k], 0)
                root = depth[todo] == 0
                low[todo], high[todo] = np.where(root, 0, self.parent_low[k]), np.where(root, len(self.suffixes), self.parent_high[k])
            over = np.flatnonzero(depth >= self.depth)
            cls = self.class_of[low[over]]
            low[over], high[over], depth[over] = self.class_start[cls], self.class_end[cls], self.depth
            length[:, p] = depth
            found[over, p] = cls
        return length, found
