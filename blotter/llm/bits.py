"""Bitmaps over hashes, made by tasks and merged by slices.

A hash addresses one 64-bit word and ``PROBES`` bits in it, so setting or testing it touches
one place. Tasks send the addresses they have seen, sorted and without repetition, to the tasks that hold the
slices of the bitmap; no task holds more than its slices, and the merged bitmap, which is
broadcast, has at most ``MOST_BITS`` however large the table is. A bitmap that is too small for its
table answers yes more often and never forgets a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBES, BITS_PER_KEY = 4, 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
# Words in a slice (32 KB; a bitmap has up to 2,048 of them), and slices that one task merges in turn.
SLICE, TOGETHER = 1 << 12, 8
# Addresses that a task gathers before it sends them.
GATHERED = 1 << 21

ADDRESSES = "slice int, addresses array<long>"
SLICES = "slice int, once binary, twice binary"

_ONE = np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_for(keys: int, most_bits: int = MOST_BITS) -> int:
    """Words of a bitmap for so many keys: a power of two within the bounds."""
    bits = min(most_bits, max(LEAST_BITS, keys * BITS_PER_KEY))
    return 1 << ((bits // 64).bit_length() - 1)


def addresses(hashes: np.ndarray, words: int) -> np.ndarray:
    """The word's number and the bits' places within it, in one long."""
    mixed = hashes.view(np.uint64) * _MIX
    mixed ^= mixed >> np.uint64(32)
    word = mixed & np.uint64(words - 1)
    return ((word << np.uint64(24)) | (mixed >> np.uint64(40))).view(np.int64)


def masks(address: np.ndarray) -> np.ndarray:
    place = address.view(np.uint64)
    out = np.zeros(len(place), dtype=np.uint64)
    for probe in range(PROBES):
        out |= _ONE << ((place >> np.uint64(6 * probe)) & np.uint64(63))
    return out


class Gathered:
    """Addresses that a task has seen: each once, or twice if it was seen more often."""

    def __init__(self, words: int):
        self.words, self.parts, self.size = words, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(hashes)
        self.size += len(hashes)
        if self.size >= GATHERED:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each slice that is touched."""
        if self.size:
            found, counts = np.unique(
                addresses(np.concatenate(self.parts), self.words), return_counts=True
            )
            found = np.repeat(found, np.minimum(counts, 2))
            slices = (found >> 24) // SLICE
            first = np.flatnonzero(np.diff(slices, prepend=-1))
            offsets = np.append(first, len(found)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slices[first].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(found)),
                ],
                names=["slice", "addresses"],
            )
        self.parts, self.size = [], 0


def merged(seen: DataFrame, words: int) -> DataFrame:
    """``(slice, once, twice)``: the bits of all addresses, and of those that were seen again."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for row, number in enumerate(batch.column(0).to_pylist()):
                if number != current:
                    if current is not None:
                        yield _slice_row(current, once, twice)
                    once, twice = (np.zeros(min(SLICE, words), dtype=np.uint64) for _ in "12")
                    current = number
                _take(values[offsets[row] : offsets[row + 1]], once, twice)
        if current is not None:
            yield _slice_row(current, once, twice)

    parts = max(1, -(-words // (SLICE * TOGETHER)))
    return (
        seen.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(merge, SLICES)
    )


def _take(address: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
    """What the first bitmap has already goes into the second."""
    fresh = np.append(True, address[1:] != address[:-1])[: len(address)]
    repeated = np.append(~fresh[1:], False)[fresh]
    address = address[fresh]
    word, mask = (address >> 24) & (SLICE - 1), masks(address)
    known = (once[word] & mask) == mask
    again = known | repeated
    np.bitwise_or.at(twice, word[again], mask[again])
    np.bitwise_or.at(once, word[~known], mask[~known])


def _slice_row(number: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int32()), *[pa.array([x.tobytes()]) for x in (once, twice)]],
        names=["slice", "once", "twice"],
    )


class Bitmap:
    """A merged bitmap as tasks test it. At most ``MOST_BITS`` come to the driver and the tasks."""

    def __init__(self, slices: DataFrame, column: str, words: int):
        table = np.zeros(words, dtype=np.uint64)
        step = min(SLICE, words)
        for row in slices.select("slice", column).collect():
            start = row["slice"] * step
            table[start : start + step] = np.frombuffer(row[column], dtype=np.uint64)
        self.words = words
        self.held = _broadcast(slices.sparkSession, table)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        address = addresses(hashes, self.words)
        mask = masks(address)
        return (self.held.value[address >> 24] & mask) == mask

    def drop(self) -> None:
        self.held.unpersist()


def _broadcast(spark: SparkSession, table: np.ndarray):
    return spark.sparkContext.broadcast(table)


def bitmap_of(keys: DataFrame, count: int, hashed=None, most_bits: int = MOST_BITS) -> Bitmap:
    """The bitmap of rows of longs: of their only column, or of what ``hashed`` makes of the columns."""
    words = words_for(count, most_bits)
    hashed = hashed or (lambda columns: columns[0])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Gathered(words)
        for batch in batches:
            yield from seen.add(hashed([column.to_numpy() for column in batch.columns]))
        yield from seen.rows()

    return Bitmap(merged(keys.mapInArrow(gather, ADDRESSES), words), "once", words)
