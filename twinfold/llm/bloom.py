"""Two Bloom filters, of hashes seen once and seen in at least two rows, made without shuffling the hashes.

Each task fills both filters from its rows. Filters merge in any order by
once = once1 | once2 and twice = twice1 | twice2 | (once1 & once2); no hash that two rows hold is
ever missing from `twice`. Filters travel as compressed segments, which of a task with few rows are short, and merge in two
steps, first among a share of the tasks, then among the shares, so no task reads the segments of all tasks. Their size follows the input's up to MAX_BITS, so what
is broadcast is bounded; on an input far beyond, more hashes are suspected, and the exact step behind has more to do, but nothing is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.plans.storage import written

#: Bounds of a filter's bits: of two filters a task holds 128 MB at most, and 64 MB are broadcast.
MIN_BITS, MAX_BITS = 1 << 20, 1 << 29
_PROBES, _SEGMENT_BITS, _SHARES = 3, 1 << 22, 64


@dataclass(frozen=True)
class Seen:
    """Bits of both filters, as bytes."""

    once: np.ndarray
    twice: np.ndarray


def bits_for(rows: DataFrame, bytes_per_hash: int) -> int:
    """A power of two, about eight bits for each hash that the optimizer's estimate of the table's size lets expect, within the bounds; a table of unknown size counts as 1 GB. Only speed hangs on it."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 1 << 30 if size >= 1 << 60 else size
    return 1 << min(MAX_BITS.bit_length() - 1, max(MIN_BITS.bit_length() - 1, (8 * size // bytes_per_hash).bit_length()))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return np.stack([((hashes + np.uint64(k) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1) for k in range(_PROBES)])


class Filter:
    """A set of 64-bit hashes that may say yes to others too."""

    def __init__(self, data: np.ndarray):
        self.data, self.bits = data, len(data) * 8

    def __contains__(self, h: int) -> bool:
        return bool(self.many(np.array([h], np.uint64))[0])

    def many(self, hashes: np.ndarray) -> np.ndarray:
        at = _places(hashes, self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        at = _places(hashes, self.bits).ravel()
        np.bitwise_or.at(self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def repeated_filter(rows: DataFrame, hashes: Callable[..., Iterable[int]], bits: int) -> Seen:
    """Filters over hashes(*row) of all rows, which a row names once each; bits is a power of two and bounds what is gathered and broadcast: bits / 4 bytes."""
    if bits & (bits - 1) or not 8 <= bits <= MAX_BITS:
        raise ValueError(f"bits: a power of two up to {MAX_BITS}")
    n_segments = max(1, bits // _SEGMENT_BITS)
    size = bits // 8 // n_segments

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, any_row = Filter(np.zeros(bits // 8, np.uint8)), Filter(np.zeros(bits // 8, np.uint8)), False
        for batch in batches:
            found = np.fromiter(chain.from_iterable(hashes(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), np.uint64)
            if len(found):
                any_row = True
                distinct, times = np.unique(found, return_counts=True)
                twice.add(distinct[(times > 1) | once.many(distinct)])
                once.add(distinct)
        if any_row:
            share = TaskContext.get().partitionId() % _SHARES
            for k in range(n_segments):
                part = slice(k * size, (k + 1) * size)
                if once.data[part].any():
                    yield packed(k, share, once.data[part], twice.data[part])

    def packed(k: int, share: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([share], pa.int32()), pa.array([zlib.compress(once, 1)], pa.binary()), pa.array([zlib.compress(twice, 1)], pa.binary())], names=["k", "share", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted segments, one row for each number and share; one pair is held at a time."""
        at, held = None, None
        for batch in batches:
            for k, share, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = Seen(*(np.frombuffer(zlib.decompress(x), np.uint8) for x in data))
                if at != (k, share):
                    if held is not None:
                        yield packed(*at, held.once, held.twice)
                    at, held = (k, share), new
                else:
                    held = Seen(held.once | new.once, held.twice | new.twice | (held.once & new.once))
        if held is not None:
            yield packed(*at, held.once, held.twice)

    schema = "k int, share int, once binary, twice binary"
    shares = rows.mapInArrow(fill, schema).repartition("k", "share").sortWithinPartitions("k", "share").mapInArrow(merge, schema)
    merged = shares.withColumn("share", F.lit(0)).repartition("k").sortWithinPartitions("k").mapInArrow(merge, schema)
    whole = Seen(np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8))
    with written(rows.sparkSession):
        for k, once, twice in merged.select("k", "once", "twice").toLocalIterator():  # a row for each segment, bits / 4 bytes in all
            part = slice(k * size, (k + 1) * size)
            whole.once[part] = np.frombuffer(zlib.decompress(once), np.uint8)
            whole.twice[part] = np.frombuffer(zlib.decompress(twice), np.uint8)
    return whole
