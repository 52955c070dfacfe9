"""A run-length compressed full-text index with vectorised backward search.

The texts of a shard are joined with separators, sorted by prefix doubling
into a suffix array and kept as the runs of their Burrows-Wheeler transform.
Runs sorted by (symbol, position) answer all rank questions of a step for a
whole batch of queries with one binary search. The place of a row is kept for
every eighth place of the text and the beginning of each; from other rows the
transform is walked back to one of these.
"""

from __future__ import annotations

import numpy as np

#: Every so many places of the text, the row of one is kept.
SAMPLE = 8

#: What may stand between two symbols of a query, from right to left: (symbols, may be many, may be none).
Gap = list[tuple[bytes, bool, bool]]


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array of a text of bytes by prefix doubling, beginning with eight bytes at once."""
    n = len(codes)
    padded = np.r_[codes.astype(np.uint64), np.zeros(8, np.uint64)]
    first = np.zeros(n, np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.r_[0, np.cumsum(np.diff(first[order]) != 0)]
    step = 8
    while rank.max(initial=0) < n - 1:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum((np.diff(a) != 0) | (np.diff(b) != 0))]
        step *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Index of ``texts``; text i is answered as i. Symbols are bytes above 1.

    ``marked`` has some offsets of each text in a row of its own; ``mark_rows``
    are their rows in the index, so that whether a query stands there is told
    by the query's range of rows.
    """

    def __init__(self, texts: list[bytes], marked: np.ndarray | None = None):
        joined = b"\x01".join([b"", *texts, b""]) + b"\x00"
        codes = np.frombuffer(joined, np.uint8).astype(np.int64)
        self.n = len(codes)
        order = suffix_array(codes)
        bwt = codes[order - 1]
        starts = np.flatnonzero(np.r_[True, np.diff(bwt) != 0])
        symbols, lengths = bwt[starts], np.diff(np.r_[starts, self.n])
        by_symbol = np.lexsort((starts, symbols))
        self._start, self._symbol, self._length = starts[by_symbol], symbols[by_symbol], lengths[by_symbol]
        self._key = self._symbol * (self.n + 1) + self._start
        self._before = np.r_[0, np.cumsum(self._length)]
        self._runs, self._run_symbol = starts, symbols
        self._bounds = np.flatnonzero(codes == 1)
        known = np.flatnonzero((order % SAMPLE == 0) | (codes[order] == 1))
        self._row, self._place = known.astype(np.int32), order[known].astype(np.int32)
        if marked is not None:
            row = np.empty(self.n, np.int32)
            row[order] = np.arange(self.n, dtype=np.int32)
            self.mark_rows = row[self._bounds[: len(texts), None] + 1 + marked]

    def smaller(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """C[symbol] + rank(symbol, row): the LF step of backward search."""
        at = np.searchsorted(self._key, symbol * (self.n + 1) + row)
        run = np.maximum(at - 1, 0)
        inside = (at > 0) & (self._symbol[run] == symbol)
        over = np.where(inside, np.maximum(self._start[run] + self._length[run] - row, 0), 0)
        return self._before[at] - over

    def maximal_matches(self, queries: list[bytes], ends: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
        """(query, start, stop, low, high) of left-maximal matches of at least ``least`` bytes.

        One backward search runs from every given end of every query. A match
        inside a longer one stays: it may stand in further texts.
        """
        lengths = np.array([len(q) for q in queries], np.int64)
        base = np.r_[0, np.cumsum(lengths)]
        text = np.frombuffer(b"".join(queries), np.uint8).astype(np.int64)
        query = np.repeat(np.arange(len(queries)), [len(e) for e in ends])
        stop = np.concatenate(ends).astype(np.int64) if ends else np.zeros(0, np.int64)
        at = stop.copy()
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        live = np.flatnonzero(at > 0)
        while len(live):
            symbol = text[base[query[live]] + at[live] - 1]
            lo, hi = self.smaller(symbol, low[live]), self.smaller(symbol, high[live])
            grown = hi > lo
            live = live[grown]
            low[live], high[live] = lo[grown], hi[grown]
            at[live] -= 1
            live = live[at[live] > 0]
        long = np.flatnonzero(stop - at >= least)
        return query[long], at[long], stop[long], low[long], high[long]

    def gapped_matches(self, queries: list[bytes], gaps: dict[int, Gap]) -> tuple[np.ndarray, ...]:
        """(query, low, high, size): the ways whole queries stand in the texts with gaps.

        ``gaps`` names, by the number of symbols left of it, what may stand
        between two symbols of any query. Backward search branches there, and
        branches without rows end; ``size`` is the number of bytes of a way.
        """
        text = np.frombuffer(b"".join(queries), np.uint8).astype(np.int64)
        left = np.array([len(q) for q in queries], np.int64)
        base = np.cumsum(left) - left
        zeros = np.zeros_like(left)
        # a column is a way: query, symbols left of it, rows from and to, bytes
        ways = np.stack([np.arange(len(queries)), left, zeros, zeros + self.n, zeros])
        whole = [ways[:, left == 0]]
        ways = ways[:, left > 0]
        while ways.shape[1]:
            ways[1] -= 1
            ways = self._extended(ways, text[base[ways[0]] + ways[1]])
            for at, gap in gaps.items():
                here = ways[1] == at
                if here.any():
                    through = ways[:, here]
                    for symbols, many, none in gap:
                        through = self._through(through, symbols, many, none)
                    ways = np.concatenate([ways[:, ~here], through], axis=1)
            whole.append(ways[:, ways[1] == 0])
            ways = ways[:, ways[1] > 0]
        query, _, low, high, size = np.concatenate(whole, axis=1)
        return query, low, high, size

    def _extended(self, ways: np.ndarray, symbol: np.ndarray | int) -> np.ndarray:
        query, left, low, high, size = ways
        low, high = self.smaller(symbol, low), self.smaller(symbol, high)
        return np.stack([query, left, low, high, size + 1])[:, high > low]

    def _through(self, ways: np.ndarray, symbols: bytes, many: bool, none: bool) -> np.ndarray:
        found = [ways] if none else []
        while ways.shape[1]:
            ways = np.concatenate([self._extended(ways, s) for s in symbols], axis=1)
            found.append(ways)
            if not many:
                break
        return np.concatenate(found, axis=1) if found else ways

    def texts_of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(match, text) for every occurrence within the row ranges."""
        return self.places_of(low, high)[:2]

    def places_of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(match, text, offset) for every occurrence within the row ranges."""
        width = high - low
        match = np.repeat(np.arange(len(low)), width)
        row = low[match] + np.arange(len(match)) - np.repeat(np.cumsum(width) - width, width)
        place = np.full(len(match), -1, np.int64)
        live, walked = np.arange(len(match)), 0
        while len(live):
            at = np.minimum(np.searchsorted(self._row, row[live]), len(self._row) - 1)
            found = self._row[at] == row[live]
            place[live[found]] = self._place[at[found]] + walked
            live, walked = live[~found], walked + 1
            symbol = self._run_symbol[np.searchsorted(self._runs, row[live], side="right") - 1]
            row[live] = self.smaller(symbol, row[live])
        text = np.searchsorted(self._bounds, place, side="right") - 1
        return match, text, place - self._bounds[text] - 1
