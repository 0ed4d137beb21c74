"""Hashes of byte runs, computed for whole Arrow batches at once.

A run ``[i, j)`` is hashed as a polynomial over 64-bit values of its bytes, modulo 2**64. Prefix sums
make the hash of any run a subtraction and a product, so that overlapping runs cost no more than
disjoint ones. The byte values and the base come from a fixed seed: hashes agree between all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ONE = np.uint64(1)


class Powers:
    """Powers of one odd base and of its inverse, shared by all hashes of a worker."""

    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 2**64)
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            up, down = np.full(n, cls.base, np.uint64), np.full(n, cls.inverse, np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


class RunHash:
    """Polynomial hash number ``number``; hashes with different numbers give bytes independent values."""

    def __init__(self, number: int):
        rng = np.random.default_rng(7_919 + number)
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.finish = np.uint64(int(rng.integers(0, 2**63, dtype=np.uint64)) | 1)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return Powers.of(n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a byte array, one longer than the array."""
        up, _ = self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[:-1], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start, stop) -> np.ndarray:
        """Hash of the bytes of each run; equal bytes give equal hashes wherever they stand."""
        _, down = self._powers(len(prefix))
        return mixed((prefix[stop] - prefix[start]) * down[start] * self.finish)

    def grams(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of every run of ``width`` bytes."""
        n = max(0, len(prefix) - width)
        _, down = self._powers(len(prefix))
        return mixed((prefix[width : width + n] - prefix[:n]) * down[:n] * self.finish)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the high bits of a product over the low ones."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array laid end to end, and the n + 1 offsets of its rows; null counts as empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cuts a batch into row ranges of at most ``most`` bytes of text each; a longer row stands alone."""
    if not batch.num_rows:
        return
    _, offsets = bytes_of(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last
