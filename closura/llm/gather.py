"""Sums of fixed-size arrays over all rows of a table, made by partial sums in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS = 16


def summed(df: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], length: int, dtype: str, plus: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray:
    """``add`` adds a batch to an array of ``length`` values; returns the sum (by ``plus``) over all batches.

    Each task sends CHUNKS pieces of its partial sum, the pieces are added by CHUNKS tasks, one row at a time, and the
    driver gets one array of fixed size, whatever the number of rows.
    """
    step = -(-length // (2 * CHUNKS)) * 2  # even: pairs of values stay together

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = np.zeros(length, dtype) if total is None else total
                add(b, total)
        if total is not None:
            for c in range(CHUNKS):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total[c * step : (c + 1) * step].tobytes()], pa.binary())], names=["c", "x"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("c").to_pylist(), b.column("x").to_pylist(), strict=True):
                v = np.frombuffer(x, dtype)
                sums[c] = plus(sums[c], v) if c in sums else v.copy()
        for c, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["c", "x"])

    out = np.zeros(length, dtype)  # one piece a chunk
    for r in df.mapInArrow(part, "c int, x binary").repartition(CHUNKS, "c").mapInArrow(merge, "c int, x binary").collect():
        v = np.frombuffer(bytes(r["x"]), dtype)
        out[r["c"] * step : r["c"] * step + len(v)] += v
    return out


class Twice:
    """Which hashes occur twice or more in a collection of sets: two bits a cell, mergeable, of a size fixed beforehand.

    ``total`` hashes get four cells each, at least 2 ** 16 and at most 2 ** 27 cells (16 MB a bitmap). A cell that more
    than one hash falls into counts as occurring twice, so a hash that ``seen`` denies occurs once for certain; where the
    cells no longer suffice, fewer are denied and nothing else changes.
    """

    def __init__(self, total: int):
        self.bits = min(27, max(16, (4 * max(total, 1) - 1).bit_length()))
        self.shift = np.uint64(64 - self.bits)

    def _cell(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def fit(self, df: DataFrame, sets: Callable[[pa.RecordBatch], np.ndarray]) -> Twice:
        words, one = (1 << self.bits) // 64, np.uint64(1)

        def add(b: pa.RecordBatch, total: np.ndarray) -> None:
            t = total.reshape(-1, 2)
            cell, n = np.unique(self._cell(sets(b)), return_counts=True)
            if not len(cell):
                return
            word, bit = (cell >> np.uint64(6)).astype(np.int64), one << (cell & np.uint64(63))
            cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            word, seen = word[cut], np.bitwise_or.reduceat(bit, cut)
            t[word, 1] |= (t[word, 0] & seen) | np.bitwise_or.reduceat(np.where(n > 1, bit, np.uint64(0)), cut)
            t[word, 0] |= seen

        def plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x, y = x.reshape(-1, 2), y.reshape(-1, 2)
            return np.stack([x[:, 0] | y[:, 0], x[:, 1] | y[:, 1] | (x[:, 0] & y[:, 0])], axis=1).ravel()

        self.twice = summed(df, add, 2 * words, "u8", plus).reshape(-1, 2)[:, 1].copy()
        return self

    def seen(self, h: np.ndarray) -> np.ndarray:
        cell = self._cell(h)
        return (self.twice[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) > 0
