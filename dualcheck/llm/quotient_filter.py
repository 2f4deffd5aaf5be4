"""Counting quotient filters over packed n-grams, without loss.

An n-gram of word ids, packed into two halves, is permuted: a Feistel network of
rounds, each of which can be taken back, spreads n-grams evenly whatever the ids
are. The first bits of the permuted key are its quotient, which names a bucket;
what is left is kept whole as the remainder. As nothing of the key is thrown
away, a counter belongs to one n-gram, and the n-gram can be read back from its
place and remainder.

A filter is kept sorted by permuted key. Written out, it has for each bucket as
many one-bits as it has entries and a zero-bit, then the remainders, then a byte
for each counter, larger ones apart. Filters of several shards are merged like
sorted runs; a range of first bits of the key is a filter by itself.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Odd 64-bit multipliers of the rounds (from the golden ratio, and public mixing functions).
ROUNDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: Counters from here on stand apart.
LARGE = 255


def _spread(x: np.ndarray, by: int, bits: int) -> np.ndarray:
    """The first ``bits`` bits of a mixed product."""
    with np.errstate(over="ignore"):
        y = (x + np.uint64(1)) * np.uint64(by)
        y ^= y >> np.uint64(31)
        y *= np.uint64(by)
    return y >> np.uint64(64 - bits)


@dataclass(frozen=True)
class Keys:
    """Permuted keys of n-grams of ``n`` (2 or 3) ids below ``2 ** bits``; the last id is the right half."""
    n: int
    bits: int

    @cached_property
    def widths(self) -> tuple[int, int]:
        return (self.n - 1) * self.bits, self.bits

    def permuted(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, right = ids[0], ids[-1]
        for x in ids[1:-1]:
            left = left << np.uint64(self.bits) | x
        for r, by in enumerate(ROUNDS):
            if r % 2:
                right = right ^ _spread(left, by, self.widths[1])
            else:
                left = left ^ _spread(right, by, self.widths[0])
        return left, right

    def inverted(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        for r, by in reversed(list(enumerate(ROUNDS))):
            if r % 2:
                right = right ^ _spread(left, by, self.widths[1])
            else:
                left = left ^ _spread(right, by, self.widths[0])
        mask = np.uint64((1 << self.bits) - 1)
        return [*(left >> np.uint64(self.bits * k) & mask for k in range(self.n - 2, -1, -1)), right]


@dataclass
class Filter:
    """Counters in the order of their permuted keys."""
    keys: Keys
    left: np.ndarray
    right: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.left)

    @staticmethod
    def of(keys: Keys, left: np.ndarray, right: np.ndarray, count: np.ndarray | None = None) -> "Filter":
        """A filter of keys in any order, repeats added up. Runs that are sorted already make the sort a merge."""
        width = keys.widths[1]
        if sum(keys.widths) <= 64:
            joint = left << np.uint64(width) | right
            if count is None:
                joint, count = np.unique(joint, return_counts=True)
                count = count.astype(np.int64)
            else:
                order = np.argsort(joint, kind="stable")
                joint, count = joint[order], count[order]
                first = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]])) if len(joint) else np.zeros(0, int)
                joint, count = joint[first], np.add.reduceat(count, first) if len(first) else count
            return Filter(keys, joint >> np.uint64(width), joint & np.uint64((1 << width) - 1), count)
        count = np.ones(len(left), np.int64) if count is None else count
        order = np.lexsort((right, left))
        left, right, count = left[order], right[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else np.zeros(0, int)
        return Filter(keys, left[first], right[first], np.add.reduceat(count, first) if len(first) else count)

    @staticmethod
    def merged(keys: Keys, filters: list["Filter"]) -> "Filter":
        if len(filters) == 1:
            return filters[0]
        none = np.zeros(0, np.uint64)
        return Filter.of(keys, np.concatenate([none, *(f.left for f in filters)]), np.concatenate([none, *(f.right for f in filters)]),
                         np.concatenate([np.zeros(0, np.int64), *(f.count for f in filters)]))

    def segments(self, bits: int) -> list[tuple[int, "Filter"]]:
        """(segment, filter) of the ranges of keys that share their first ``bits`` bits and aren't empty."""
        shift = np.uint64(self.keys.widths[0] - bits)
        segment = self.left >> shift if bits else np.zeros(len(self), np.uint64)
        at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(self) else np.zeros(0, int)
        return [(int(segment[a]), Filter(self.keys, self.left[a:b], self.right[a:b], self.count[a:b])) for a, b in zip(at, [*at[1:], len(self)])]

    def to_bytes(self, segment_bits: int = 0) -> bytes:
        """The filter's compact form; all keys must share their first ``segment_bits`` bits, which are left out."""
        wide, narrow = self.keys.widths
        low = wide - segment_bits
        buckets = min(max(len(self).bit_length() - 1, 0), low)
        rest = np.uint64(low - buckets)
        left = self.left & np.uint64((1 << low) - 1) if low < 64 else self.left
        quotient = (left >> rest).astype(np.int64) if buckets else np.zeros(len(self), np.int64)
        ones = np.zeros(len(self) + (1 << buckets), np.uint8)
        ones[quotient + np.arange(len(self))] = 1
        large = self.count >= LARGE
        head = np.array([len(self), buckets, int(large.sum())], "<i8")
        return b"".join([head.tobytes(), np.packbits(ones).tobytes(), _cut(left & np.uint64((1 << int(rest)) - 1) if rest < 64 else left, int(rest)), _cut(self.right, narrow),
                         np.where(large, LARGE, self.count).astype(np.uint8).tobytes(), self.count[large].astype("<i8").tobytes()])

    @staticmethod
    def from_bytes(keys: Keys, data: bytes, segment: int = 0, segment_bits: int = 0) -> "Filter":
        wide, narrow = keys.widths
        n, buckets, n_large = np.frombuffer(data, "<i8", 3).tolist()
        at, low = 24, wide - segment_bits
        size = (n + (1 << buckets) + 7) // 8
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n + (1 << buckets)))
        at += size
        rest = low - buckets
        left, at = _uncut(data, at, n, rest)
        right, at = _uncut(data, at, n, narrow)
        count = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        count[count == LARGE] = np.frombuffer(data, "<i8", n_large, at + n)
        if buckets:
            left = left | (ones - np.arange(n)).astype(np.uint64) << np.uint64(rest)
        if segment_bits:
            left = left | np.uint64(segment) << np.uint64(low)
        return Filter(keys, left, right, count)


def _cut(x: np.ndarray, bits: int) -> bytes:
    """Numbers below ``2 ** bits`` in as few bytes each as hold them."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8].tobytes()


def _uncut(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").reshape(-1), at + n * size
