"""Elias-Fano coding of a non-decreasing sequence, with select structures for direct access.

Each value's low bits are stored as they are; its high part is a one at place ``high + index`` of a bit vector. Space
is about ``2 + log2(range / n)`` bits a value. ``select(i)`` starts at the nearest sampled one, so that single values
are read without decoding the rest.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QqB")


def encode(values: np.ndarray) -> bytes:
    """Values must not decrease; an empty sequence is allowed."""
    values = np.asarray(values, np.int64)
    n = len(values)
    least = int(values[0]) if n else 0
    if n and (np.diff(values) < 0).any():
        raise ValueError("values decrease")
    rest = (values.view(np.uint64) - np.array(least, np.int64).view(np.uint64)) if n else np.zeros(0, np.uint64)
    top = int(rest[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = ((rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    upper[ones] = 1
    lower, high = np.packbits(bits, bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4" if len(upper) < 2**32 else "<u8").tobytes()
    head = _HEAD.pack(n, least, low) + struct.pack("<QQQ", len(lower), len(high), len(samples))
    return head + lower + high + samples


class EliasFano:
    """Reads what ``encode`` wrote, from ``data`` at ``at``; ``end`` is where it stops."""

    def __init__(self, data: bytes | memoryview, at: int = 0) -> None:
        self.n, self.least, self.low = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        sizes = struct.unpack_from("<QQQ", data, at)
        at += 24
        self.lower, self.upper = (
            np.frombuffer(data, np.uint8, sizes[0], at),
            np.frombuffer(data, np.uint8, sizes[1], at + sizes[0]),
        )
        n_samples = -(-self.n // SAMPLE)
        kind = "<u8" if n_samples and sizes[2] // n_samples == 8 else "<u4"
        self.samples = np.frombuffer(data, kind, n_samples, at + sizes[0] + sizes[1])
        self.end = at + sum(sizes)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        value = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low and self.n:
            bits = np.unpackbits(self.lower, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            value |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (value + np.array(self.least, np.int64).view(np.uint64)).view(np.int64)

    def select(self, i: int) -> int:
        """The i-th value alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        need += int(np.unpackbits(self.upper[byte : byte + 1], bitorder="little")[: place % 8].sum())
        while (ones := int(self.upper[byte]).bit_count()) <= need:
            need -= ones
            byte += 1
        one = byte * 8 + int(np.flatnonzero(np.unpackbits(self.upper[byte : byte + 1], bitorder="little"))[need])
        value = (one - i) << self.low
        for k in range(self.low):
            bit = i * self.low + k
            value |= (int(self.lower[bit // 8]) >> (bit % 8) & 1) << k
        return value + self.least
