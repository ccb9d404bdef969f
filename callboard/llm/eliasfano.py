"""Monotone integer sequences in about two bits and a low part per value, searched in place.

All parts of a sequence lie in one buffer without pointers, so a level can be written to a file
and memory-mapped as it is.  Searches come in batches, so the unary part is decoded once for a
batch, as the places of its ones or zeros.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

HEAD = struct.Struct("<QQBQQ")


class EliasFano:
    """values (sorted, may repeat) below universe: the low bits packed, the high parts in unary."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))  # a low part and its bit offset fit a word
        values = values.astype(np.uint64)
        low = np.zeros(-(-n * low_bits // 8) + 8, np.uint8)
        if n and low_bits:
            parts = values & np.uint64((1 << low_bits) - 1)
            if low_bits >= 8:  # every eighth value begins on a byte, and their words do not overlap
                words = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
                for k in range(min(8, n)):
                    bit = np.arange(k, n, 8) * low_bits
                    words[bit >> 3] |= parts[k::8] << np.uint64(k * low_bits & 7)
            else:
                bits = parts[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
                packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
                low[: len(packed)] = packed
        size = (universe >> low_bits) + n + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"))

    def to_bytes(self) -> bytes:
        return HEAD.pack(self.n, self.universe, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_buffer(cls, buffer, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence at an offset of bytes or of a memory map, and where it ends."""
        n, universe, low_bits, low, high = HEAD.unpack_from(buffer, at)
        at += HEAD.size
        return cls(n, universe, low_bits, np.frombuffer(buffer, np.uint8, low, at), np.frombuffer(buffer, np.uint8, high, at + low)), at + low + high

    @cached_property
    def _ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.high, bitorder="little").view(bool))

    @cached_property
    def _zeros(self) -> np.ndarray:
        return np.flatnonzero(~np.unpackbits(self.high, bitorder="little").view(bool))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        words = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))
        return (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _search(self, values: np.ndarray, least: np.ndarray | None, most: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """For each value, the first index not below it among those of its high part, and their end."""
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        want = values & np.uint64((1 << self.low_bits) - 1)
        begin, stop = np.where(high > 0, self._zeros[np.maximum(high - 1, 0)] - (high - 1), 0), self._zeros[high] - high
        if least is not None:
            begin, stop = np.maximum(begin, least), np.minimum(stop, most)
        rows = np.flatnonzero(begin < stop)
        a, b, low = begin[rows], stop[rows], want[rows]
        while len(rows):
            middle = (a + b) >> 1
            less = self._lows(middle) < low
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            open_ = a < b
            begin[rows[~open_]] = a[~open_]
            rows, a, b, low = rows[open_], a[open_], b[open_], low[open_]
        return begin, stop

    def first(self, values: np.ndarray) -> np.ndarray:
        """The index of the first entry that is no less than each value (n if there is none)."""
        values = values.astype(np.uint64)
        inside = (values >> np.uint64(self.low_bits)) <= np.uint64(self.universe >> self.low_bits)
        return np.where(inside, self._search(np.where(inside, values, 0).astype(np.uint64), None, None)[0], self.n)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The entries at the given indices."""
        return ((self._ones[at] - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(at)

    def find(self, values: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """The index of an entry equal to each value, or -1; only from ``least`` to before ``most``, if given."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        values = values.astype(np.uint64)
        at, stop = self._search(values, least, most)
        found = np.flatnonzero(at < stop)
        same = self._lows(at[found]) == values[found] & np.uint64((1 << self.low_bits) - 1)
        out = np.full(len(values), -1, np.int64)
        out[found[same]] = at[found[same]]
        return out
