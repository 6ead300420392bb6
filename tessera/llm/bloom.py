"""A once-seen and a twice-seen Bloom filter over 64-bit hashes.

The hashes are dealt by their first bits into ranges, as many as their number
asks for.  A range's hashes stream through its once filter, which stays in the
one task that the range has; a hash whose bits are all set there (or that stood
twice in what was dealt) goes on as seen twice.  Only these make the twice
filter, whose bits are built slice by slice and sent to all tasks.

Before they are dealt, equal hashes of a task meet and count as one, so a hash
that a third of all rows have weighs no more than a few rows a task.  No task
holds more than a filter of fixed size and one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.llm.workspace import Workspace

#: At most 64 MB for the twice filter; a fuller one suspects more, and forgets nothing.
MOST_BITS, SLICE_BITS = 1 << 29, 1 << 20
#: Hashes of a range, bits and functions of its once filter (8 MB).
RANGE_HASHES, RANGE_BITS, FUNCTIONS = 1 << 22, 1 << 26, 4
#: Hashes that a task gathers before it hands them on.
GATHERED = 1 << 20


def _positions(hashes: np.ndarray, bits: int, functions: int = 2) -> list[np.ndarray]:
    """Places in a filter: by the last bits of the hash, and of hashes of it."""
    found, h = [], hashes
    for k in range(functions):
        found.append((h & np.uint64(bits - 1)).astype(np.int64))
        h = ta.mixed(h + np.uint64(k))
    return found


def _set(held: np.ndarray, hashes: np.ndarray, bits: int, functions: int) -> None:
    for place in _positions(hashes, bits, functions):
        place = np.sort(place)
        at, first = np.unique(place >> 3, return_index=True)
        held[at] |= np.bitwise_or.reduceat((1 << (place & 7)).astype(np.uint8), first)


def _has(held: np.ndarray, hashes: np.ndarray, bits: int, functions: int) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for place in _positions(hashes, bits, functions):
        hit &= (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
    return hit


def _dealer(ranges: int):
    shift = np.uint64(65 - ranges.bit_length())  # ranges: a power of two

    def rows(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, count = np.unique(np.concatenate(gathered), return_counts=True)
        number = (values >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(values), np.int64)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(values)]))
        own = [(int(number[a]), values[a:b].tobytes(), values[a:b][count[a:b] > 1].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "hashes", "again"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each task: distinct hashes by range, and which of them stood twice."""
        gathered, size = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    gathered.append(np.frombuffer(x, np.uint64))
                    size += len(gathered[-1])
                if size >= GATHERED:
                    yield from rows(gathered)
                    gathered, size = [], 0
        if gathered:
            yield from rows(gathered)

    return deal


def _meeter(bits: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of their ranges: hashes that the once filter of the range has already."""
        number, once = None, None
        for batch in batches:
            for own, hashes, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != number:
                    number, once = own, np.zeros(bits // 8, np.uint8)
                values = np.frombuffer(hashes, np.uint64)
                twice = values[_has(once, values, bits, FUNCTIONS)]
                _set(once, values, bits, FUNCTIONS)
                twice = np.union1d(twice, np.frombuffer(again, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(twice.view(np.int64), pa.int64())], ["hash"])

    return meet


def seen_twice(hashes: DataFrame, range_hashes: int = RANGE_HASHES, range_bits: int = RANGE_BITS) -> DataFrame:
    """(hash) of a table (n, hashes): every hash that stands in it twice, and a few that don't."""
    n = hashes.agg(F.sum("n")).first()[0] or 0
    least = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << (max(least, -(-n // range_hashes)) - 1).bit_length()
    dealt = hashes.select("hashes").mapInArrow(_dealer(ranges), "range long, hashes binary, again binary")
    return dealt.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_meeter(range_bits), "hash long").distinct()


def _slicer(bits: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(_positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            if not len(place):
                continue
            number = place // SLICE_BITS
            at = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(place)]))
            inner = (place % SLICE_BITS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([int(number[a]) for a in at[:-1]], pa.int64()), pa.array([inner[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["slice", "places"])

    return cut


def _join_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their slices: each slice's bits, once it ends."""
    number, bits = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])
    for batch in batches:
        for own, places in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            if own != number:
                if number is not None:
                    yield out()
                number, bits = own, np.zeros(SLICE_BITS, bool)
            bits[np.frombuffer(places, np.uint32)] = True
    if number is not None:
        yield out()


def twice_filter(hashes: DataFrame, work: Workspace, most_bits: int = MOST_BITS, range_hashes: int = RANGE_HASHES, range_bits: int = RANGE_BITS) -> tuple[Broadcast, int]:
    """The twice-seen filter of a table (n, hashes): counts and 64-bit hashes as bytes; sent to all tasks, with its number of bits."""
    found = work.save(seen_twice(hashes, range_hashes, range_bits), "twice")
    n = found.count()
    bits = min(most_bits, max(SLICE_BITS, 1 << (16 * n - 1).bit_length() if n else 0))
    slices = found.mapInArrow(_slicer(bits), "slice long, places binary").repartition(max(1, bits // SLICE_BITS), "slice").sortWithinPartitions("slice")
    twice = bytearray(bits // 8)
    for row in slices.mapInArrow(_join_slices, "slice long, bits binary").toLocalIterator():
        twice[row["slice"] * SLICE_BITS // 8 : (row["slice"] + 1) * SLICE_BITS // 8] = row["bits"]
    work.drop("twice")
    return hashes.sparkSession.sparkContext.broadcast(bytes(twice)), bits


def is_twice(hashes: np.ndarray, twice: np.ndarray, bits: int) -> np.ndarray:
    return _has(twice, hashes, bits, 2)
