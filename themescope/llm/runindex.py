"""Run-length compressed Burrows-Wheeler index of many short texts, and matching statistics.

The texts end at separators; their suffixes are sorted up to there, equal ones by place.
The index keeps, for each run of equal symbols of the transform, its symbol, its first row,
where its rows go (LF) and the text positions of its first and last row; suffix array and
transform are dropped.  Patterns are read from their ends, all in step: where the run's
symbol is the wanted one the match grows by it, else it moves to the end of the run before
or the start of the run after that has the symbol, whichever shares more with the match.
"""

from __future__ import annotations

import numpy as np


def _joined(texts: list[bytes]):
    """Symbols (byte + 1; 0 ends a text), first position of each text, bytes with padding."""
    raw = np.frombuffer(b"\0".join(texts) + bytes(17), np.uint8)
    n = len(raw) - 16
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols = raw[:n].astype(np.int64) + 1
    symbols[ends] = 0
    return symbols, ends, raw


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions by suffix up to its separator, equal ones by position; ``left``: symbols up to it."""
    n, packed = len(symbols), 7
    rank = np.zeros(n, np.int64)
    for k in range(packed):                              # seven symbols of nine bits
        there = np.flatnonzero(left >= k)
        rank[there] |= symbols[there + k] << (9 * (packed - 1 - k))
    rank = np.unique(rank, return_inverse=True)[1]
    depth, longest = packed, int(left.max()) + 1
    while depth < longest:
        there = np.flatnonzero(left >= depth)
        second = np.zeros(n, np.int64)
        second[there] = rank[there + depth] + 1
        rank = np.unique(rank * np.int64(n + 1) + second, return_inverse=True)[1]
        depth *= 2
    return np.argsort(rank, kind="stable")


class RunIndex:
    def __init__(self, texts: list[bytes]):
        symbols, ends, self.raw = _joined(texts)
        n = len(symbols)
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        order = suffix_order(symbols, self.left)
        transform = symbols[order - 1]
        edge = np.flatnonzero(np.concatenate(([True], transform[1:] != transform[:-1])))
        size = np.diff(np.append(edge, n))
        self.start, self.symbol = edge, transform[edge]
        by_symbol = np.argsort(self.symbol, kind="stable")
        self.to = np.empty(len(edge), np.int64)          # LF of a run's first row
        self.to[by_symbol] = np.cumsum(size[by_symbol]) - size[by_symbol]
        self.size = size
        self.first, self.last = order[edge], order[edge + size - 1]
        self.by_symbol = by_symbol
        self.place = self.symbol[by_symbol] * len(edge) + by_symbol
        self.words = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))

    def _common(self, x, y, most):
        """Equal bytes at text positions x and y, at most ``most`` and up to y's separator."""
        most = np.minimum(most, self.left[y])
        got = np.zeros(len(x), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            differ = self.words[x[live] + got[live]] ^ self.words[y[live] + got[live]]
            lowest = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
            got[live] += equal
            live = live[(differ == 0) & (got[live] < most[live])]
        return np.minimum(got, most)

    def matching_statistics(self, texts: list[bytes], least: int) -> list[np.ndarray]:
        """For each pattern the positions at which a match of at least ``least`` bytes starts.
        A pattern is left as soon as its match ends before ``least``: ends never move right."""
        size = np.array([len(t) for t in texts])
        longest, count = int(size.max()), len(texts)
        chars = np.zeros((longest, count), np.int64)     # row t: symbol t places before the end
        flat = np.frombuffer(b"".join(texts), np.uint8)
        row = np.repeat(np.arange(count), size)
        chars[(np.cumsum(size)[row] - 1 - np.arange(len(flat))), row] = flat.astype(np.int64) + 1
        at, pos = np.zeros(count, np.int64), np.full(count, self.first[0])
        length = np.zeros(count, np.int64)
        runs, found, live = len(self.start), [], np.arange(count)
        for t in range(longest):
            live = q = live[size[live] > t]
            if len(q) == 0:
                break
            c = chars[t, q]
            run = np.searchsorted(self.start, at[q], "right") - 1
            same = self.symbol[run] == c
            grow, r = q[same], run[same]
            at[grow] += self.to[r] - self.start[r]
            pos[grow] -= 1
            length[grow] += 1
            move, r, c = q[~same], run[~same], c[~same]
            after = np.searchsorted(self.place, c * runs + r)
            best = np.full(len(move), -1)
            for before in (True, False):
                k = after - 1 if before else after
                k = np.clip(k, 0, runs - 1)
                near = self.by_symbol[k]
                there = np.flatnonzero((self.symbol[near] == c) & ((near < r) if before else (near > r)))
                near, m = near[there], move[there]
                sample = (self.last if before else self.first)[near]
                common = self._common(pos[m], sample, length[m]) if len(m) else np.zeros(0, np.int64)
                better = common > best[there]
                there, near, m, sample = there[better], near[better], m[better], sample[better]
                best[there] = common[better]
                if before:
                    row_to, pos_to = np.zeros(len(move), np.int64), np.zeros(len(move), np.int64)
                row_to[there] = self.to[near] + (self.size[near] - 1 if before else 0)
                pos_to[there] = sample - 1
            hit = best >= 0
            length[move] = best + 1
            at[move[hit]], pos[move[hit]] = row_to[hit], pos_to[hit]
            live = q[size[q] - 1 - t + length[q] >= least]
            long = live[length[live] >= least]
            found.append((long, size[long] - 1 - t))
        who, where = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((where, who))
        who, where = who[order], where[order]
        cut = np.searchsorted(who, np.arange(count + 1))
        return [where[a:b] for a, b in zip(cut[:-1], cut[1:])]
