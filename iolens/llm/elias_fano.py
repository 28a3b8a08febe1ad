"""Elias-Fano coding of a rising sequence of whole numbers, with a select structure.

Of each number the lowest ``width`` bits are stored as they are; the rest in unary, as bit
``(number >> width) + index`` of a bit string. The position of every ``EVERY``-th set bit is stored
too, so a number is found by looking at one short stretch of the bit string. That is
2 + log2(last / count) bits a number and 1/8 bit for the samples.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 256
_HEAD = struct.Struct("<QQBQ")


def encode(values: np.ndarray) -> bytes:
    """``values``: numbers from 0 to 2^62, each at least the one before; may be empty."""
    values = np.asarray(values, dtype=np.int64)
    n = len(values)
    last = int(values[-1]) if n else 0
    width = max(0, (last // n).bit_length() - 1) if n else 0
    high = (values >> width) + np.arange(n, dtype=np.int64)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    bits[high] = 1
    low = (values[:, None] >> np.arange(width, dtype=np.int64)) & 1
    low_bytes = np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()
    samples = high[::EVERY].astype("<u4" if len(bits) < 1 << 32 else "<u8").tobytes()
    return _HEAD.pack(n, len(bits), width, len(low_bytes)) + low_bytes + np.packbits(
        bits, bitorder="little"
    ).tobytes() + samples


class EliasFano:
    """Reads numbers from the coded form without decoding the others."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.n, self.bits, self.width, low = _HEAD.unpack_from(data)
        raw = np.frombuffer(data, np.uint8, offset=_HEAD.size)
        high = -(-self.bits // 8)
        self.low, self.high = raw[:low], raw[low : low + high]
        size = "<u4" if self.bits < 1 << 32 else "<u8"
        count = -(-self.n // EVERY)
        self.samples = np.frombuffer(raw[low + high :].tobytes(), size, count=count)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The number at place ``i`` from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.samples[i // EVERY]), i % EVERY
        start, length = at // 8, 64
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[start : start + length], bitorder="little"))
            ones = ones[ones >= at - 8 * start]
            if len(ones) > rest:
                break
            length *= 2
        return ((8 * start + int(ones[rest]) - i) << self.width) | self._low(i)

    def _low(self, i: int) -> int:
        first, end = i * self.width, (i + 1) * self.width
        whole = int.from_bytes(self.low[first // 8 : -(-end // 8)].tobytes(), "little")
        return whole >> (first % 8) & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, count=self.bits, bitorder="little"))
        bits = np.unpackbits(self.low, count=self.n * self.width, bitorder="little").reshape(self.n, self.width)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))
        return ((ones - np.arange(self.n)) << self.width) | low
