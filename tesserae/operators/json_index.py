"""A structural index over JSON text, computed with vector operations.

A whole batch of documents is one byte buffer. Bitmaps of quotes and
structural characters give, by prefix sums, which bytes lie inside strings and
how deep every bracket lies. Sorting the structural characters by depth pairs
brackets, orders the commas of each container and so yields every value's span
and its parent, without walking any document.
"""

from __future__ import annotations

import json

import numpy as np

_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord("{"), ord("[")]] = True
_CLOSE[[ord("}"), ord("]")]] = True
_STRUCTURAL = _OPEN | _CLOSE
_STRUCTURAL[[ord(","), ord(":")]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


class JsonIndex:
    """All values below the top level of a batch of JSON objects or arrays.

    Per value: ``doc``, ``parent`` (index of the containing value, -1 at the
    top), ``depth`` (1 at the top), ``position`` in its container, key span
    (``key_start`` = -1 in arrays) and value span ``start``:``stop``.
    ``texts`` must be valid JSON without raw line feeds inside strings, which
    JSON forbids anyway.
    """

    def __init__(self, texts: list[str]):
        self.data = ("\n".join(t.replace("\n", " ") for t in texts) + "\n").encode()
        b = self.buffer = np.frombuffer(self.data, np.uint8)
        quotes = np.flatnonzero(b == 34)
        slashes = np.flatnonzero(b == 92)
        if len(slashes):  # a quote after an odd run of back-slashes is escaped
            first = np.r_[True, np.diff(slashes) > 1]
            run_start = slashes[first][np.cumsum(first) - 1]
            odd_end = slashes[(slashes - run_start) % 2 == 0] + 1
            quotes = quotes[~np.isin(quotes, odd_end, assume_unique=True)]
        self.quotes = quotes
        marks = np.flatnonzero(_STRUCTURAL[b])
        marks = marks[np.searchsorted(quotes, marks) % 2 == 0]
        kind = b[marks]
        opens, closes = _OPEN[kind], _CLOSE[kind]
        depth = np.cumsum(opens) - np.cumsum(closes) + closes  # a closing bracket has the depth of its opening one
        ends = np.flatnonzero(b == 10)

        order = np.argsort(depth, kind="stable")
        pos, kind, opens, closes, depth = marks[order], kind[order], opens[order], closes[order], depth[order]
        n = len(pos)
        owner = np.maximum.accumulate(np.where(opens, np.arange(n), 0)) if n else np.zeros(0, int)
        is_array = kind[owner] == ord("[") if n else np.zeros(0, bool)
        colon, comma = kind == ord(":"), kind == ord(",")
        commas = np.cumsum(comma)
        place = commas - commas[owner] if n else commas

        begins = colon | (is_array & (comma | opens))
        at = np.flatnonzero(begins)
        start = pos[at] + 1
        # the value ends at the next comma or closing bracket of the same container
        stops = np.flatnonzero(comma | closes)
        stop = pos[stops[np.searchsorted(stops, at, side="right")]] if len(at) else start
        start, stop = self._stripped(start, stop)
        full = stop > start  # an empty array has no value
        at, start, stop = at[full], start[full], stop[full]
        by_start = np.argsort(start, kind="stable")
        at, self.start, self.stop = at[by_start], start[by_start], stop[by_start]
        self.depth = depth[at]
        self.position = place[at]
        self.doc = np.searchsorted(ends, self.start)
        container = pos[owner[at]]
        found = np.searchsorted(self.start, container)
        inside = (found < len(self.start)) & (self.depth > 1)
        self.parent = np.where(inside, found, -1)

        self.key_start = np.full(len(at), -1, np.int64)
        self.key_stop = self.key_start.copy()
        named = kind[at] == ord(":")
        close_quote = np.searchsorted(quotes, pos[at][named]) - 1
        self.key_start[named] = quotes[close_quote - 1] + 1
        self.key_stop[named] = quotes[close_quote]

    def _stripped(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while len(start) and (grow := (start < stop) & _SPACE[self.buffer[start]]).any():
            start = start + grow
        while len(stop) and (shrink := (start < stop) & _SPACE[self.buffer[stop - 1]]).any():
            stop = stop - shrink
        return start, stop

    def key_is(self, rows: np.ndarray, name: str) -> np.ndarray:
        want = np.frombuffer(name.encode(), np.uint8)
        start, fits = self.key_start[rows], self.key_stop[rows] - self.key_start[rows] == len(want)
        out = fits & (start >= 0)
        hit = np.flatnonzero(out)
        if len(hit) and len(want):
            out[hit] = (self.buffer[start[hit][:, None] + np.arange(len(want))] == want).all(axis=1)
        return out

    def starts_with(self, rows: np.ndarray, text: bytes) -> np.ndarray:
        want = np.frombuffer(text, np.uint8)
        at = self.start[rows]
        fits = self.stop[rows] - at >= len(want)
        return fits & (self.buffer[np.where(fits, at, 0)[:, None] + np.arange(len(want))] == want).all(axis=1)

    def is_null(self, rows: np.ndarray) -> np.ndarray:
        return self.starts_with(rows, b"null") & (self.stop[rows] - self.start[rows] == 4)

    def text(self, row: int) -> str:
        return self.data[self.start[row] : self.stop[row]].decode()

    def key(self, row: int) -> str:
        raw = self.data[self.key_start[row] : self.key_stop[row]]
        return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode()

    def label(self, row: int) -> str:
        """Key of a member, or place of an element as text."""
        return self.key(row) if self.key_start[row] >= 0 else str(self.position[row])

    def labels(self, rows: np.ndarray) -> list[str]:
        """``label`` of many rows."""
        starts, stops, data = self.key_start[rows].tolist(), self.key_stop[rows].tolist(), self.data
        out = [data[a:b].decode() if a >= 0 else str(p) for a, b, p in zip(starts, stops, self.position[rows].tolist())]
        for i in (i for i, t in enumerate(out) if "\\" in t):
            out[i] = self.label(rows[i])
        return out

    def texts(self, rows: np.ndarray) -> list[str]:
        """``text`` of many rows."""
        data = self.data
        return [data[a:b].decode() for a, b in zip(self.start[rows].tolist(), self.stop[rows].tolist())]

    def select(self, path: tuple[str, ...]) -> np.ndarray:
        """Rows at ``path``; ``*`` is any key, ``#`` any element."""
        rows = np.flatnonzero(self.depth == 1)
        for level, step in enumerate(path):
            if level:
                rows = np.flatnonzero((self.parent >= 0) & np.isin(self.parent, rows))
            if step == "#":
                rows = rows[self.key_start[rows] < 0]
            elif step == "*":
                rows = rows[self.key_start[rows] >= 0]
            else:
                rows = rows[self.key_is(rows, step)]
        return rows
