"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

The strings of a collection lie in columns, aligned by their anchors. From the
last column to the first, each round inserts one symbol of every string: the
sorted suffixes that start one column later are sorted stably by that symbol,
which is a column of the transform (the symbols before sorted suffixes), and so
become the sorted suffixes that start here. A suffix shares one symbol more with
its predecessor than the least that its old neighbours down to that predecessor
share, so common prefixes follow without comparing strings. A string joins in
the column of its last symbol and leaves behind its first.

Suffixes of other columns are not kept in the order: strings of one anchor that
hold the same window hold it in the same column, as the anchor is part of it. A
round is therefore linear in the number of strings. Symbols lie column by column
in an external file; order and common prefixes go to files of their own. Each is
read and written from beginning to end, once a round.
"""
from __future__ import annotations

import os
from tempfile import TemporaryDirectory

import numpy as np

#: Strings whose symbols are turned into columns at a time.
TURNED = 2048


class Collection:
    """Strings in columns, and the state between rounds, as files of a folder."""

    def __init__(self, folder: str, strings: list[bytes], columns: np.ndarray):
        self.folder, self.count = folder, len(strings)
        self.held: dict[str, int] = {}
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = columns - columns.min()
        self.ends = self.starts + lengths
        self.width = int(self.ends.max())
        # 0 is no symbol; a byte is its value plus one, and UTF-8 has no byte 255
        turned = np.memmap(self._path("symbols"), np.uint8, "w+", shape=(max(1, self.width), self.count))
        place = np.arange(self.width)
        for lo in range(0, self.count, TURNED):
            hi = min(lo + TURNED, self.count)
            block = np.zeros((hi - lo, self.width), np.uint8)
            block[(place >= self.starts[lo:hi, None]) & (place < self.ends[lo:hi, None])] = np.frombuffer(b"".join(strings[lo:hi]), np.uint8) + 1
            turned[:self.width, lo:hi] = block.T
        turned.flush()
        self.write("order", np.zeros(0, np.int32))
        self.write("prefixes", np.zeros(0, np.uint8))

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def symbols(self, column: int) -> np.ndarray:
        return np.fromfile(self._path("symbols"), np.uint8, self.count, offset=column * self.count)

    def read(self, name: str, kind: type) -> np.ndarray:
        return np.fromfile(self._path(name), kind, self.held[name])

    def write(self, name: str, values: np.ndarray) -> None:
        # written over, as some file systems write a file to disk at once when it has been cut to nothing
        with open(self._path(name), "r+b" if name in self.held else "wb") as f:
            values.tofile(f)
        self.held[name] = len(values)


def insert(collection: Collection, column: int, joining: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the strings whose suffixes start in ``column``, sorted by them, and common prefixes up to ``cap``."""
    # the empty suffixes of strings that join come first
    order = np.concatenate([joining, collection.read("order", np.int32)])
    shared = np.concatenate([np.zeros(len(joining), np.uint8), collection.read("prefixes", np.uint8)])
    transform = collection.symbols(column)[order]
    grown = np.argsort(transform, kind="stable")
    grown = grown[len(grown) - np.count_nonzero(transform):]
    symbol = transform[grown]
    now = np.zeros(len(grown), np.uint8)
    alike = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
    if len(alike):
        between = np.stack([grown[alike - 1] + 1, grown[alike] + 1], 1).ravel()
        least = np.minimum.reduceat(np.append(shared, np.uint8(0)), between)[::2]
        now[alike] = np.minimum(least, cap - 1) + 1
    order = order[grown]
    collection.write("order", order)
    collection.write("prefixes", now)
    return order, now


def repeated_windows(strings: list[bytes], columns: list[int], length: int) -> list[np.ndarray]:
    """For each string and each place where ``length`` bytes start: whether another string holds the same bytes in the
    same columns. ``columns`` are those of the strings' first bytes."""
    if not strings:
        return []
    if not 0 < length < 255:
        raise ValueError("windows are 1 to 254 bytes long")
    with TemporaryDirectory() as folder:
        collection = Collection(folder, strings, np.array(columns, np.int64))
        starts, ends = collection.starts, collection.ends
        windows = np.maximum(ends - starts - length + 1, 0)
        begin = np.cumsum(windows) - windows
        found = np.zeros(int(windows.sum()), bool)
        by_end = np.argsort(ends, kind="stable").astype(np.int32)
        joins = np.searchsorted(ends[by_end], np.arange(collection.width + 2))
        for column in reversed(range(collection.width)):
            order, shared = insert(collection, column, by_end[joins[column + 1]:joins[column + 2]], length)
            long = shared >= length
            long[:-1] |= long[1:]
            who = order[long]
            found[begin[who] + column - starts[who]] = True
    return [found[b:b + n] for b, n in zip(begin.tolist(), windows.tolist())]
