"""Counts of 64-bit keys in groups, pre-aggregated in each task and shuffled as packed arrays."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import column

PACKED = "bucket int, grp int, size long, keys binary, counts binary"
NAMES = ["bucket", "grp", "size", "keys", "counts"]


class KeyCounts:
    """Sorted distinct keys and their counts per group; memory follows the distinct keys."""

    def __init__(self, slack: int = 1 << 21):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.slack, self.loose = slack, 0

    def add(self, grp: int, keys: np.ndarray) -> None:
        if len(keys):
            self.add_counts(grp, *np.unique(keys, return_counts=True))

    def add_counts(self, grp: int, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts[grp].append((keys, counts.astype(np.int64)))
        self.loose += len(keys)
        if self.loose > self.slack:
            for g in self.parts:
                self.parts[g] = [self.merged(g)]
            self.loose = 0

    def merged(self, grp: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts[grp]) == 1:
            return self.parts[grp][0]
        keys, counts = (np.concatenate(x) for x in zip(*self.parts[grp], strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def packed(self, shift: int):
        """One row per group and bucket (key >> shift), its keys and counts as little-endian arrays."""
        rows = []
        for grp in sorted(self.parts):
            keys, counts = self.merged(grp)
            bucket = (keys >> np.uint64(shift)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for at, to in zip(first, [*first[1:], len(keys)], strict=True):
                rows.append((int(bucket[at]), grp, int(to - at), keys[at:to].astype("<u8").tobytes(), _narrow(counts[at:to])))
                if len(rows) >= 256:
                    yield packed_batch(rows)
                    rows = []
        if rows:
            yield packed_batch(rows)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest of them; the width is read off the length."""
    for kind in ("<u1", "<u2", "<u4"):
        if counts.max() <= np.iinfo(kind).max:
            return counts.astype(kind).tobytes()
    return counts.astype("<u8").tobytes()


def unpack(size: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, "<u8"), np.frombuffer(counts, f"<u{len(counts) // size}").astype(np.int64)


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


def packed_rows(batch: pa.RecordBatch):
    for bucket, grp, size, keys, counts in zip(*(column(batch, c).to_pylist() for c in NAMES), strict=True):
        yield bucket, grp, *unpack(size, keys, counts)


def sum_counts(partial: DataFrame, buckets: int, shift: int) -> DataFrame:
    """Add up packed partial counts: one row per group and bucket, over the whole table.

    A key is one entry per task whatever its count, so a frequent key is no hot spot; a task holds
    the distinct keys of its buckets.
    """

    def run(batches):
        held = KeyCounts()
        for batch in batches:
            for _, grp, keys, counts in packed_rows(batch):
                held.add_counts(grp, keys, counts)
        yield from held.packed(shift)

    return partial.repartition(buckets, F.col("bucket")).mapInArrow(run, PACKED)
