"""A compressed FM-index over word ids: wavelet tree over the BWT, backward search, capped matching statistics."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: What no document owns.
NOBODY = np.iinfo(np.int64).max


class BitVector:
    """Bits packed 64 to a word, with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, dtype=bool))), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((_ONE << bit) - _ONE)).astype(np.int64)


class WaveletTree:
    """Rank over a sequence of small integers; level by level, zeros go before ones."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (sequence >> shift & 1).astype(bool)
            self.levels.append((shift, BitVector(bits), int(len(bits) - bits.sum())))
            sequence = np.concatenate((sequence[~bits], sequence[bits]))
        symbols = np.arange(sigma)
        self.start = self._walk(symbols, np.zeros(sigma, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``at`` places."""
        return self._walk(symbol, at) - self.start[symbol]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols or more, and the symbols that each shares with the one before it (``depth`` at most)."""
    n, rank, reach = len(text), text.astype(np.int64), 1
    levels = []
    while reach < depth:
        levels.append(rank)
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - reach] = rank[reach:] + 1
        rank = np.unique(rank * (max(n, int(rank.max()) + 1) + 2) + ahead, return_inverse=True)[1]
        reach *= 2
    order = np.argsort(rank, kind="stable")
    one, two, shared = order[:-1], order[1:], np.zeros(max(n - 1, 0), dtype=np.int64)
    same = rank[one] == rank[two]
    for i in range(len(levels) - 1, -1, -1):
        level = np.append(levels[i], -1)
        shared += np.where(level[np.minimum(one + shared, n)] == level[np.minimum(two + shared, n)], 1 << i, 0) * ~same
    return order, np.concatenate(([0], np.where(same, depth, np.minimum(shared, depth))))


class FMIndex:
    """Index of several passages (lists of words), each with the smallest id of the documents that hold it.

    ``depth`` is the match length of interest: matching statistics are followed up to it, and rows of the suffix order
    whose suffixes share ``depth`` words form one class with one owner, the smallest. Words are compared as they are.
    """

    def __init__(self, passages: list[list[bytes]], owners: np.ndarray, depth: int):
        self.depth = depth
        self.ids: dict[bytes, int] = {}
        lengths = np.fromiter((len(p) for p in passages), dtype=np.int64, count=len(passages))
        flat: list[int] = []
        for p in passages:
            flat.append(0)  # symbol 0 before each passage keeps them apart
            flat.extend([self.ids.setdefault(w, len(self.ids) + 1) for w in p])
        flat.append(0)
        text = np.asarray(flat, dtype=np.int64)
        self.size, sigma = len(text), len(self.ids) + 1
        order, shared = suffix_order(text, depth)
        self.tree = WaveletTree(text[order - 1], sigma)
        self.count = np.bincount(text, minlength=sigma)
        self.before = np.cumsum(self.count) - self.count
        first = np.flatnonzero(shared < depth)
        self.run = np.cumsum(shared < depth) - 1
        self.run_start, self.run_end = first, np.append(first[1:], self.size)
        owner = np.append(np.repeat(owners, lengths + 1), NOBODY)
        self.run_owner = np.minimum.reduceat(owner[order], first)
        # for some lengths, the first of the rows that share so many symbols with a row, and the end of these rows
        self.lengths = np.array([x for x in range(depth) if x < 8 or x % (8 if x > 16 else 4) == 0])
        self.starts, self.ends = (np.zeros((len(self.lengths), self.size), dtype=np.int32) for _ in range(2))
        for i, x in enumerate(self.lengths):
            edge = np.append(np.flatnonzero(shared < x) if x else 0, self.size)
            self.starts[i], self.ends[i] = (np.repeat(e, np.diff(edge)) for e in (edge[:-1], edge[1:]))
        # least number of shared symbols over ranges of rows of power-of-two length
        self.least = [shared.astype(np.min_scalar_type(depth))]
        while 2 << (len(self.least) - 1) <= self.size:
            last, gap = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-gap], last[gap:]))

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """Words as symbols; 0 for a word that the index doesn't have."""
        return np.fromiter((self.ids.get(w, 0) for w in words), dtype=np.int64, count=len(words))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of ``symbol`` + pattern from those of the pattern."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.before[symbol] + both[: len(symbol)], self.before[symbol] + both[len(symbol) :]

    def rows(self, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes share their first ``length`` symbols with that of ``row``."""
        low, high = row.copy(), row + 1
        for k in range(len(self.least) - 1, -1, -1):
            table, gap = self.least[k], 1 << k
            at = low - gap
            low = np.where((at >= 0) & (table[np.clip(at + 1, 0, len(table) - 1)] >= length), at, low)
            fits = high + gap <= self.size
            high = np.where(fits & (table[np.clip(high, 0, len(table) - 1)] >= length), high + gap, high)
        return low, high

    def shorter(self, symbol: np.ndarray, row: np.ndarray, length: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the match at ``row`` can't be extended: the longest beginning of it that can, and its rows with ``symbol`` before it.

        -1 where that is shorter than ``need``. Lengths with known rows are tried first, then those between two of them.
        """
        low, high = self.before[symbol], self.before[symbol] + self.count[symbol]
        last = len(self.lengths) - 1
        place = np.zeros(len(symbol), dtype=np.int64)
        most = np.searchsorted(self.lengths, length - 1, side="right") - 1
        able = np.ones(len(symbol), dtype=bool)
        middle = np.searchsorted(self.lengths, np.minimum(need, length - 1), side="right") - 1
        able[need >= length] = False
        asked = np.flatnonzero(able & (most > 0))
        first = True
        while len(asked):
            # what is needed is asked for first: most passages end there
            m = np.where((middle[asked] > 0) & first, middle[asked], (place[asked] + most[asked] + 1) // 2)
            a, b = self.step(symbol[asked], self.starts[m, row[asked]].astype(np.int64), self.ends[m, row[asked]].astype(np.int64))
            good = a < b
            up, down = asked[good], asked[~good]
            low[up], high[up], place[up] = a[good], b[good], m[good]
            most[down] = m[~good] - 1
            able[down] &= self.lengths[m[~good]] > need[down]
            asked = asked[able[asked] & (place[asked] < most[asked])]
            first = False
        short = self.lengths[place]
        long = np.minimum(length - 1, np.where(place < last, self.lengths[np.minimum(place + 1, last)] - 1, self.depth))
        asked = np.flatnonzero(able & (short < long))
        while len(asked):
            m = (short[asked] + long[asked] + 1) // 2
            a, b = self.step(symbol[asked], *self.rows(row[asked], m))
            good = a < b
            up, down = asked[good], asked[~good]
            low[up], high[up], short[up] = a[good], b[good], m[good]
            long[down] = m[~good] - 1
            asked = asked[short[asked] < long[asked]]
        return low, high, np.where(able & (short >= need), short, -1)

    def matching_statistics(self, streamed: list[np.ndarray], least: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each place of each streamed passage: the length of the longest match that starts there (``depth`` at most), and
        where that is ``depth``, the smallest owner of these words (else NOBODY).

        All passages advance together from their last word backwards. A match that can't be extended falls to its longest
        beginning that can; one beyond ``depth`` gives up its last word. With ``least``, a passage is left as soon as no
        match of that length can come in it; statistics from there on are given as 0.
        """
        many = len(streamed)
        lengths = np.fromiter((len(s) for s in streamed), dtype=np.int64, count=many)
        end = np.cumsum(lengths)
        text = np.concatenate(streamed) if many else np.zeros(0, dtype=np.int64)
        low, high, size = np.zeros(many, dtype=np.int64), np.full(many, self.size, dtype=np.int64), np.zeros(many, dtype=np.int64)
        length, owner = np.zeros(len(text), dtype=np.int64), np.full(len(text), NOBODY, dtype=np.int64)
        alive = np.arange(many)
        for done in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[(lengths[alive] >= done) & (size[alive] + lengths[alive] - done + 1 >= least)]
            if not len(alive):
                break
            at = end[alive] - done
            symbol = text[at]
            known = symbol > 0
            a, b = self.step(symbol, low[alive], high[alive])
            m = size[alive]
            fall = np.flatnonzero(known & (a >= b))
            if len(fall):
                need = np.maximum(least - 1 - (lengths[alive[fall]] - done), 0)
                a[fall], b[fall], m[fall] = self.shorter(symbol[fall], low[alive[fall]], m[fall], need)
            lost = m < 0
            a, b, m = np.where(known, a, 0), np.where(known, b, self.size), np.where(known, m + 1, 0)
            full = np.flatnonzero(m >= self.depth)
            run = self.run[a[full]]
            a[full], b[full], m[full] = self.run_start[run], self.run_end[run], self.depth
            owner[at[full]] = self.run_owner[run]
            length[at] = m
            low[alive], high[alive], size[alive] = a, b, m
            alive = alive[~lost]
        cut = end[:-1] if many else []
        return np.split(length, cut), np.split(owner, cut)
