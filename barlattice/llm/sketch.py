"""Count-min sketches that are filled by partition and merged by Spark.

Two probes in one array of small counters that stop at 3: an estimate is never below min(true count, 3), so what
is estimated 1 stands once. Sent packed, four counters a byte; merged block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_CELLS = 1 << 22
_SECOND = np.uint64(0xA0761D6478BD642F)


def cells_for(items: float, per_item: float, most: int, least: int = 1 << 16) -> int:
    """A power of two, about per_item counters an item, between the bounds."""
    return int(min(most, max(least, 1 << int(np.ceil(np.log2(max(1.0, items * per_item)))))))


def probes(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return (keys & mask).astype(np.int64), ((keys * _SECOND) >> np.uint64(20) & mask).astype(np.int64)


class Filling:
    """Counters of one partition, packed as they are sent."""

    def __init__(self, cells: int):
        self.cells, self.packed = cells, np.zeros(cells // 4, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for at in probes(keys, self.cells):
            cell, times = np.unique(at, return_counts=True)
            times = np.minimum(times, 3).astype(np.uint8)
            for k in range(4):  # the k-th counters of bytes: a byte occurs once in each turn
                mine = cell & 3 == k
                byte, shift = cell[mine] >> 2, np.uint8(2 * k)
                now = self.packed[byte] >> shift & 3
                self.packed[byte] += (np.minimum(now + times[mine], 3) - now) << shift

    def blocks(self):
        step = min(BLOCK_CELLS, self.cells) // 4
        for k in range(len(self.packed) // step):
            part = self.packed[k * step : (k + 1) * step]
            if part.any():
                yield k, part.tobytes()


def pack(counts: np.ndarray) -> np.ndarray:
    c = counts.reshape(-1, 4)
    return c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6


def unpack(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)


def merged(parts: DataFrame, cells: int) -> np.ndarray:
    """The packed sketch of all partitions' (block, counters) rows: cells / 4 bytes, whatever the input's size."""

    def add(block: pa.Table) -> pa.Table:
        total = None
        for packed in block["counters"]:
            part = unpack(np.frombuffer(packed.as_buffer(), np.uint8))
            total = part if total is None else np.minimum(total + part, 3)
        return pa.table({"block": pa.array([block["block"][0].as_py()], pa.int32()), "counters": pa.array([pack(total).tobytes()], pa.binary())})

    out, step = np.zeros(cells // 4, np.uint8), min(BLOCK_CELLS, cells) // 4
    for row in parts.groupBy("block").applyInArrow(add, "block int, counters binary").toLocalIterator():
        out[row["block"] * step : (row["block"] + 1) * step] = np.frombuffer(bytes(row["counters"]), np.uint8)
    return out


def at_least_two(packed: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in probes(keys, cells):
        out &= (packed[at >> 2] >> ((at & 3) * 2).astype(np.uint8) & 3) >= 2
    return out


def few_tasks(docs: DataFrame) -> DataFrame:
    """Fewer, larger tasks without a shuffle, since each sends a sketch."""
    return docs.coalesce(max(1, 2 * docs.sparkSession.sparkContext.defaultParallelism))


__all__ = ["Filling", "at_least_two", "cells_for", "few_tasks", "merged"]
