"""A Bloom filter over SHA-256 digests, filled and probed with numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sizing(items: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 8) and hash functions."""
    items = items or 1
    rate = rate if 0 < rate < 1 else 0.01
    bits = math.ceil(-items * math.log(rate) / (math.log(2) * math.log(2)))
    bits = (bits + 7) // 8 * 8
    return bits, max(1, math.ceil(bits / items * math.log(2)))


def positions(digests: list[bytes], size: int, hashes: int) -> np.ndarray:
    """A row of bit numbers for each digest: h1 + n h2 + n n modulo 2^64, then modulo the size."""
    if not digests:
        return np.empty((0, hashes), np.int64)
    halves = np.frombuffer(b"".join(d[:16] if len(d) >= 16 else bytes(16) for d in digests), ">u8").reshape(-1, 2).astype(np.uint64)
    n = np.arange(hashes, dtype=np.uint64)
    found = (halves[:, :1] + n * halves[:, 1:] + n * n) % np.uint64(size)
    found[[len(d) < 16 for d in digests]] = 0
    return found.astype(np.int64)


@dataclass(frozen=True)
class Bloom:
    size: int
    hashes: int
    data: bytes

    def __post_init__(self) -> None:
        if len(self.data) != (self.size + 7) // 8:
            raise ValueError("the filter's data do not fit its size")

    @classmethod
    def of(cls, digests: list[bytes], size: int, hashes: int) -> Bloom:
        bits = np.zeros((size + 7) // 8 * 8, np.uint8)
        bits[positions(digests, size, hashes).reshape(-1)] = 1
        return cls(size, hashes, np.packbits(bits, bitorder="little").tobytes())

    def test(self, digests: list[bytes]) -> np.ndarray:
        """Whether each digest may be in the filter."""
        at = positions(digests, self.size, self.hashes)
        bits = np.frombuffer(self.data, np.uint8)
        return ((bits[at >> 3] >> (at & 7)) & 1).astype(bool).all(axis=1)

    def __or__(self, other: Bloom) -> Bloom:
        both = np.frombuffer(self.data, np.uint8) | np.frombuffer(other.data, np.uint8)
        return Bloom(self.size, self.hashes, both.tobytes())


def filled(digests: DataFrame, size: int, hashes: int, parts: int = 8) -> Bloom:
    """A filter with the digests of a one-column DataFrame; parts filters at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom.of([], size, hashes)
        for batch in batches:
            own |= Bloom.of(batch.column(0).to_pylist(), size, hashes)
        yield pa.RecordBatch.from_arrays([pa.array([own.data], pa.binary())], names=["data"])

    out = Bloom.of([], size, hashes)
    for row in digests.coalesce(parts).mapInArrow(run, "data binary").collect():
        out |= Bloom(size, hashes, bytes(row.data))
    return out
