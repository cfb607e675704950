"""How often hashes occur, counted without shuffling them: counters that hashes share.

Each task counts its own hashes in one array; arrays travel as compressed segments and are summed in two steps, first among a share of the tasks,
then among the shares, as in bloom.py. What comes back tells a hash's rank: the logarithm of its counter, in one byte. Hashes that
share a counter get the rank of their sum, so ranks serve for an order from rare to common that is the same everywhere, not for exact counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.plans.storage import written

#: Bounds of the counters: a task holds 128 MB of them at most, and 16 MB are broadcast.
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 24
_SEGMENT, _SHARES = 1 << 18, 64
#: Ranks that a doubling of the count makes.
_STEPS = 8


def slots_for(hashes: int) -> int:
    """A power of two, at least twice the number of hashes within the bounds. Only speed hangs on it."""
    return 1 << min(MAX_SLOTS.bit_length() - 1, max(MIN_SLOTS.bit_length() - 1, (2 * hashes).bit_length()))


def slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The counter of each unsigned hash."""
    return ((hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) & np.uint64(slots - 1)).astype(np.int64)


def ranks(rows: DataFrame, slots: int) -> np.ndarray:
    """A byte for each counter, over all rows of one column, binary, of little-endian unsigned 64-bit hashes; slots is a power of two."""
    if slots & (slots - 1) or not 1 <= slots <= MAX_SLOTS:
        raise ValueError(f"slots: a power of two up to {MAX_SLOTS}")
    size = min(slots, _SEGMENT)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_row = np.zeros(slots, np.int64), False
        for batch in batches:
            for data in batch.column(0):
                found = np.frombuffer(data.as_buffer(), np.uint64)
                any_row |= len(found) > 0
                np.add.at(counts, slot(found, slots), 1)
        if any_row:
            share = TaskContext.get().partitionId() % _SHARES
            for k in range(slots // size):
                if (part := counts[k * size : (k + 1) * size]).any():
                    yield packed(k, share, part)

    def packed(k: int, share: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([share], pa.int32()), pa.array([zlib.compress(counts, 1)], pa.binary())], names=["k", "share", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted segments; one is held at a time."""
        at, held = None, None
        for batch in batches:
            for k, share, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = np.frombuffer(zlib.decompress(data), np.int64)
                if at != (k, share):
                    if held is not None:
                        yield packed(*at, held)
                    at, held = (k, share), new
                else:
                    held = held + new
        if held is not None:
            yield packed(*at, held)

    schema = "k int, share int, counts binary"
    shares = rows.mapInArrow(fill, schema).repartition("k", "share").sortWithinPartitions("k", "share").mapInArrow(merge, schema)
    merged = shares.withColumn("share", F.lit(0)).repartition("k").sortWithinPartitions("k").mapInArrow(merge, schema)
    out = np.zeros(slots, np.uint8)
    with written(rows.sparkSession):
        for k, data in merged.select("k", "counts").toLocalIterator():  # one segment at a time
            counts = np.frombuffer(zlib.decompress(data), np.int64)
            out[k * size : (k + 1) * size] = np.minimum(255, _STEPS * np.log2(1 + counts)).astype(np.uint8)
    return out
