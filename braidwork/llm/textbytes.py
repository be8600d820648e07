"""Vectorised views of a batch of texts as one run of UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of ODD modulo 2 ** 64.
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def parts(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Slices of a batch whose texts hold about `most` bytes together (a longer text stands alone)."""
    low, held = 0, 0
    lengths = np.diff(offsets_of(batch.column(column))) if batch.num_rows else []
    for i, n in enumerate(lengths):
        if i > low and held + n > most:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += int(n)
    if low < batch.num_rows:
        yield batch.slice(low)


def offsets_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text begins, and the end): the column holds no nulls."""
    ends = offsets_of(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Hashes of any byte ranges of one run of bytes, modulo 2 ** 64; other seeds give other hashes."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(mix64(data.astype(np.uint64) + np.uint64(1 + (seed << 8))) * powers(ODD, len(data)), out=self.sums[1:])
        self.back = powers(ODD_INVERSE, len(data) + 1)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix64((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(np.uint64))


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without white space that stay inside one text: begin, end, and each text's first word (and the end)."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = ~IS_SPACE[data]
    begins_here = solid[1:] & ~solid[:-1]
    cuts = starts[1:-1]
    cuts = cuts[(cuts < len(data))]
    begins_here[cuts] |= solid[1:][cuts]
    begin = np.flatnonzero(begins_here)
    stop = solid[1:-1].copy()
    after = np.ones(len(data) + 1, dtype=bool)
    after[: len(data)] = ~solid[1:-1]
    after[cuts] = True
    end = np.flatnonzero(stop & after[1:]) + 1
    return begin, end, np.searchsorted(begin, starts)
