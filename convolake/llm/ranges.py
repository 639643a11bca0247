"""Ranges of places in documents, found by many tasks and brought together per document.

Places found by hash are scattered over the shards. A task hands on one block per bucket of documents instead of a row per
document, so that the rows on the way grow with tasks and buckets and not with documents times shards. In its bucket a
document gets one row, with neighbouring ranges merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from convolake.llm.words import mix

BUCKET_BYTES = 16 << 20  # of text in a bucket
FLUSH_RANGES = 4_000_000  # a task holds, at most
NO_ID = -(2**63)
BLOCK = "bucket int, docs binary, counts binary, starts binary, lengths binary"


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal neighbours."""
    if not len(values):
        return []
    cuts = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(values)], strict=True))


def merged(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same places in as few ranges as possible, ordered by document and start."""
    order = np.lexsort((start, doc))
    begin = (doc[order].astype(np.int64) << 32) + start[order]
    end = np.maximum.accumulate(begin + length[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    last = np.concatenate([first[1:], [len(begin)]]) - 1
    return begin[first] >> 32, begin[first] & 0xFFFFFFFF, end[last] - begin[first]


class Ranges:
    """Ranges that a task has found. Documents are named by (doc_id, key)."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self._clear()

    def _clear(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.named = self.size = 0

    def add(self, names: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Takes ranges of the documents ``names[doc]`` (single places without ``length``); blocks once enough are held."""
        if len(doc):
            used, doc = np.unique(doc, return_inverse=True)
            length = np.ones(len(doc), np.int32) if length is None else length
            self.held.append((names[used], doc + self.named, start, length))
            self.named += len(used)
            self.size += len(doc)
        if self.size >= FLUSH_RANGES:
            yield from self.blocks()

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        names, doc, start, length = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self._clear()
        names, code = np.unique(names, axis=0, return_inverse=True)  # a document may come several times
        hashes = mix(names[:, 0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ names[:, 1].view(np.uint64))
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[by_bucket] = np.arange(len(names))
        names, bucket = names[by_bucket], bucket[by_bucket]
        doc, start, length = merged(rank[code.reshape(-1)[doc]], start, length)
        for x, y in runs(bucket[doc]):
            which = runs(doc[x:y])
            who = names[doc[x:y][[i for i, _ in which]]]
            counts = np.array([j - i for i, j in which], np.int32)
            data = [who.tobytes(), counts.tobytes(), start[x:y].astype(np.int32).tobytes(), length[x:y].astype(np.int32).tobytes()]
            columns = [pa.array([int(bucket[doc[x]])], pa.int32()), *(pa.array([d], pa.binary()) for d in data)]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(5)])


def unpack(docs: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The names of a block and, per entry, the index of its name."""
    who = np.frombuffer(docs.as_buffer(), np.int64).reshape(-1, 2)
    return who, np.repeat(np.arange(len(who)), np.frombuffer(counts.as_buffer(), np.int32))


def by_document(blocks: DataFrame) -> DataFrame:
    """(doc_id, key, ranges) of blocks: one row per document, ranges packed as pairs of int32 (start, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, named = [], 0
        for batch in batches:
            for docs, counts, start, length in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                who, of = unpack(docs, counts)
                held.append((who, of + named, np.frombuffer(start.as_buffer(), np.int32), np.frombuffer(length.as_buffer(), np.int32)))
                named += len(who)
        if not held:
            return
        names, doc, start, length = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        names, code = np.unique(names, axis=0, return_inverse=True)
        doc, start, length = merged(code.reshape(-1)[doc], start, length)
        pairs = np.column_stack([start, length]).astype(np.int32)
        spans = runs(doc)
        for at in range(0, len(spans), 5000):
            part = spans[at : at + 5000]
            who = names[doc[[i for i, _ in part]]]
            ids = [None if d == NO_ID else d for d in who[:, 0].tolist()]
            columns = [pa.array(ids, pa.int64()), pa.array(who[:, 1], pa.int64()), pa.array([pairs[i:j].tobytes() for i, j in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["0", "1", "2"])

    return blocks.repartition("bucket").mapInArrow(run, "doc_id bigint, key bigint, ranges binary")


def covered(ranges: bytes, size: int, width: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``width`` places that starts in one of the ranges."""
    pairs = np.frombuffer(ranges, np.int32).reshape(-1, 2).astype(np.int64)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 0] + pairs[:, 1] - 1 + width, -1)
    return np.cumsum(change[:-1]) > 0
