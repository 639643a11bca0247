"""A count-min sketch of 64-bit hashes whose counters stop at two, merged from partial sketches of partitions.

It overestimates: a hash that occurs twice is always reported as repeated. Its size follows the number of hashes up to
``MOST_BITS`` per row, which bounds what is sent to every task; beyond that it lets more single hashes pass, which costs
time in the exact pass that must follow and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEPTH = 2
LEAST_BITS, MOST_BITS = 16, 28
FLUSH = 4_000_000  # hashes a task gathers before it hands on a partial sketch
PART_BITS = 24  # cells of a row in one part
_LOW = 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * _ODD[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _partials(hashes: np.ndarray, bits: int) -> Iterator[tuple]:
    """(row, part, cells per 65 536, low halves of the cells seen, cells seen twice), a part at a time."""
    part_bits = min(PART_BITS, bits)
    for row in range(DEPTH):
        c = np.sort(cells(hashes, row, bits))
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        once, twice = c[new], np.unique(c[~new])
        bounds = np.arange(1 + (1 << (bits - part_bits)), dtype=np.uint64) << np.uint64(part_bits)
        for part, (i, j, k, n) in enumerate(
            zip(*[x for b in (np.searchsorted(once, bounds), np.searchsorted(twice, bounds)) for x in (b[:-1], b[1:])], strict=True)
        ):
            if j > i:
                local = once[i:j] - np.uint32(part << part_bits)
                counts = np.bincount(local >> np.uint32(_LOW), minlength=1 << max(0, part_bits - _LOW)).astype(np.uint32)
                again = twice[k:n] - np.uint32(part << part_bits)
                yield row, part, counts.tobytes(), local.astype(np.uint16).tobytes(), again.tobytes()


def _merged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    part_bits = min(PART_BITS, bits)
    once: dict[tuple, np.ndarray] = {}
    twice: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for row, part, counts, low, again in zip(*(batch.column(i) for i in range(5)), strict=True):
            key = row.as_py(), part.as_py()
            if key not in once:
                once[key], twice[key] = np.zeros(1 << part_bits, bool), np.zeros(1 << part_bits, bool)
            counts = np.frombuffer(counts.as_buffer(), np.uint32)
            local = np.repeat(np.arange(len(counts), dtype=np.uint32) << np.uint32(_LOW), counts) | np.frombuffer(low.as_buffer(), np.uint16)
            seen = once[key]
            twice[key][local[seen[local]]] = True
            seen[local] = True
            twice[key][np.frombuffer(again.as_buffer(), np.uint32)] = True
    for (row, part), found in twice.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([row], pa.int32()), pa.array([part], pa.int32()), pa.array([np.packbits(found).tobytes()], pa.binary())], names=["0", "1", "2"]
        )


class Repeated:
    """Reports hashes that the merged sketch takes for repeated. Holds at most ``DEPTH * 2 ** MOST_BITS`` bits."""

    def __init__(self, bits: int, rows: list[np.ndarray]):
        self.bits, self.rows = bits, rows

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for row, packed in enumerate(self.rows):
            c = cells(hashes, row, self.bits)
            found &= (packed[c >> np.uint32(3)] >> (np.uint8(7) - (c & np.uint32(7)).astype(np.uint8))) & np.uint8(1) > 0
        return found


def repeated_hashes(docs: DataFrame, hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: int) -> Repeated:
    """The merged sketch of what ``hashes_of`` yields from the Arrow batches of ``docs``."""
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * max(1, expected) - 1).bit_length()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row, part, *data in _partials(np.concatenate(held), bits):
                columns = [pa.array([row], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in data)]
                yield pa.RecordBatch.from_arrays(columns, names=["0", "1", "2", "3", "4"])

        for hashes in hashes_of(batches):
            held.append(hashes)
            n += len(hashes)
            if n >= FLUSH:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    partial = docs.mapInArrow(gather, "row int, part int, counts binary, low binary, again binary")
    merged = partial.repartition("row", "part").mapInArrow(lambda b: _merged(b, bits), "row int, part int, twice binary")
    rows = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(DEPTH)]
    size = (1 << min(PART_BITS, bits)) // 8
    for row, part, found in merged.toLocalIterator():  # bounded by MOST_BITS
        rows[row][part * size : (part + 1) * size] = np.frombuffer(found, np.uint8)
    return Repeated(bits, rows)


