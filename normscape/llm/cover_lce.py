"""Longest common extensions in a sequence by a difference cover: only the suffixes at covered places are sorted."""

from __future__ import annotations

import numpy as np

from normscape.llm.common import mix

#: A perfect difference set: every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = 13, np.array([0, 1, 3, 9])
#: Residue -> its number in COVER, -1 outside.
_NUMBER = np.full(PERIOD, -1)
_NUMBER[COVER] = np.arange(len(COVER))
#: Difference -> the member x of COVER for which x plus the difference is in COVER too.
_FIRST = np.zeros(PERIOD, np.int64)
for _x in COVER:
    _FIRST[(COVER - _x) % PERIOD] = _x


class CoverLCE:
    """lce(i, j): how many numbers from place i on equal those from place j on. seq: non-negative numbers.

    Blocks of PERIOD numbers at covered places get names, the covered suffixes are sorted as sequences of names by
    doubling, and a sparse table over the common blocks of neighbours answers for any two of them. Two places compare
    at most PERIOD numbers until both are covered, take the common blocks, and compare at most PERIOD numbers more.
    """

    def __init__(self, seq: np.ndarray):
        self.n = len(seq)
        n_blocks = self.n // PERIOD + 1
        self.seq = np.concatenate([seq, np.full(2 * PERIOD, -1, seq.dtype)])
        places = (np.arange(n_blocks)[:, None] * PERIOD + COVER).ravel()  # the place of covered suffix x; x + len(COVER) is PERIOD further
        self.places = np.minimum(places, self.n)
        names = self._named()
        levels, step = [names], len(COVER)
        while step < len(names) and int(names.max()) + 1 < len(names):
            after = np.full(len(names), -1)
            after[:-step] = names[step:]
            names = np.unique((names << 32) | (after + 1), return_inverse=True)[1]
            levels.append(names)
            step *= 2
        order = np.argsort(names, kind="stable")
        self.rank = np.empty(len(names), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [self._neighbours(order, levels)]
        while (width := 1 << len(self.table)) <= len(order) - 1:
            last, half = self.table[-1], width // 2
            self.table.append(np.minimum(last[: len(last) - half], last[half:]))

    def _named(self) -> np.ndarray:
        """A number for each covered block, equal for equal blocks: by a hash, whose names are then checked."""
        window = np.lib.stride_tricks.sliding_window_view(self.seq, PERIOD)[self.places]
        salt = 1
        while True:
            h = np.full(len(window), salt, np.uint64)
            for j in range(PERIOD):
                h = mix(h + window[:, j].astype(np.uint64))
            _, first, names = np.unique(h, return_index=True, return_inverse=True)
            if (window == window[first[names]]).all():
                return names
            salt += 1

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common blocks of each covered suffix and the next in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            for _ in range(2 if k == len(levels) - 1 else 1):  # the last level may hold twice: it stops once all differ
                inside = np.maximum(a, b) < len(order)
                same = inside.copy()
                same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
                common += same * (1 << k)
                a += same * (len(COVER) << k)
                b += same * (len(COVER) << k)
        return common

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal numbers from i and j on, looking at no more than most (PERIOD at the largest)."""
        got = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            a, b = i[live] + got[live], j[live] + got[live]
            live = live[(np.maximum(a, b) < self.n) & (self.seq[np.minimum(a, self.n)] == self.seq[np.minimum(b, self.n)])]
            got[live] += 1
            live = live[got[live] < most[live]]
        return got

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places; a place may be the end of the sequence."""
        until = (_FIRST[(j - i) % PERIOD] - i) % PERIOD
        got = self._compared(i, j, until)
        on = np.flatnonzero((got == until) & (np.maximum(i, j) + got < self.n))
        if not len(on):
            return got
        a, b = i[on] + got[on], j[on] + got[on]
        ra, rb = (self.rank[x // PERIOD * len(COVER) + _NUMBER[x % PERIOD]] for x in (a, b))
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        k = np.frexp(high - low)[1] - 1  # the largest power of two in the range
        blocks = np.empty(len(on), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            t = self.table[level]
            blocks[at] = np.minimum(t[low[at]], t[high[at] - (1 << level)])
        got[on] += blocks * PERIOD
        rest = on[np.maximum(i[on], j[on]) + got[on] < self.n]
        got[rest] += self._compared(i[rest] + got[rest], j[rest] + got[rest], np.full(len(rest), PERIOD))
        return got
