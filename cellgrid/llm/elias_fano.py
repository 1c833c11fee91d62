"""Elias-Fano code of a non-decreasing sequence, with a select structure."""

from __future__ import annotations

import struct

import numpy as np

#: One position in so many set bits is kept, to start a select from.
SAMPLE = 512


class EliasFano:
    """n values up to u take about 2 + log2(u / n) bits each.

    Values are cut into low bits, stored as they are, and high parts, stored in
    unary: bit (high + i) is set for value i.  select(i) finds the i-th set bit
    from the nearest sample before it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        size = (int(ones[-1]) + 1 if n else 0) + 7 >> 3
        flags = np.zeros(size * 8, dtype=np.uint8)
        flags[ones] = 1
        parts = (v[:, None] >> np.arange(bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8) if bits else np.zeros((n, 0), np.uint8)
        return cls(n, bits, np.packbits(parts.ravel(), bitorder="little"), np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def _lows(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, dtype=np.uint64)
        first, last = a * self.low_bits, b * self.low_bits
        flags = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
        return (flags.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def range(self, a: int, b: int) -> np.ndarray:
        """Values a to b-1."""
        if a >= b:
            return np.zeros(0, dtype=np.uint64)
        k = a // SAMPLE
        byte = int(self.samples[k]) >> 3
        end = (int(self.samples[(b - 1) // SAMPLE + 1]) >> 3) + 1 if (b - 1) // SAMPLE + 1 < len(self.samples) else len(self.high)
        found = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + byte * 8
        skip = int(np.searchsorted(found, int(self.samples[k]))) + a - k * SAMPLE
        ones = found[skip : skip + b - a].astype(np.uint64)
        return ((ones - np.arange(a, b, dtype=np.uint64)) << np.uint64(self.low_bits)) | self._lows(a, b)

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.range(i, i + 1)[0])

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b, c = struct.unpack_from("<QQQQQ", data)
        at = 40
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, bits, low, high, np.frombuffer(data, "<u8", c, at + a + b))
