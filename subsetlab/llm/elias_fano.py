"""Elias-Fano coding of a non-decreasing sequence of whole numbers, with select.

A sequence of n numbers up to u takes about n * (2 + log2(u / n)) bits: the low bits of each lie in a packed
array, the high bits as unary gaps in a bit vector. ``select`` finds a number from the position of its one bit: a
sample of every ``STEP``-th one leads close to it, counting the ones of whole bytes does the rest.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ones between two samples of the select structure.
STEP = 256
_HEAD = struct.Struct("<QQBI")
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


class EliasFano:
    """The coded sequence: ``low_bits`` bits of each number in ``low``, unary gaps of the rest in ``high``."""

    def __init__(self, n: int, last: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.last, self.low_bits, self.low, self.high, self.samples = n, last, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("the values must be non-negative and must not fall")
        last = int(values[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(bool).ravel(), bitorder="little")
        place = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(place[-1]) + 1 if n else 0, dtype=bool)
        high[place] = True
        return cls(n, last, low_bits, low, np.packbits(high, bitorder="little"), place[::STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.last, self.low_bits, len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        n, last, low_bits, n_high = _HEAD.unpack_from(data)
        n_low, n_samples = (n * low_bits + 7) // 8, -(-n // STEP)
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return cls(n, last, low_bits, low, high, samples)

    def select(self, i: int) -> int:
        """Return number ``i`` without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // STEP])
        rest, byte = i % STEP, place // 8
        rest += int(_ONES[int(self.high[byte]) & ((1 << place % 8) - 1)])
        while (ones := int(_ONES[self.high[byte]])) <= rest:
            rest -= ones
            byte += 1
        inside = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[rest]
        high = 8 * byte + int(inside) - i
        low = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (int(self.low[at // 8]) >> at % 8 & 1) << k
        return high << self.low_bits | low

    def all(self) -> np.ndarray:
        """Return all numbers."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        high = place - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return (high.astype(np.int64) << self.low_bits) + low
