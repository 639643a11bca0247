"""Repeated word windows: a count-min prefilter, then an exact pass over the windows estimated repeated.

The first pass over the texts builds the merged sketch of all windows. The second hands on only windows that it takes
for repeated; windows that a task itself has seen twice are settled there and go on once, so that a passage in a third of
all documents costs one record per task. Records meet by hash; what occurs twice goes back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import slices, text_key
from convolake.llm.ranges import BLOCK, BUCKET_BYTES, NO_ID, Ranges, by_document, covered, merged, runs, unpack
from convolake.llm.sketch import FLUSH, repeated_hashes
from convolake.llm.words import WordHasher

WINDOW = 35
SHARD_WINDOWS = 1_000_000
# Per shard: documents (id, key), windows per document, first words and hashes of the windows. Settled ones come as ranges:
# first words and how many windows, without hashes.
RECORD = "shard int, docs binary, counts binary, starts binary, lengths binary, h1 binary, h2 binary"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))


def _block(shard: int, names: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray | None = None, *hashes: np.ndarray) -> pa.RecordBatch:
    each = runs(doc)
    who = names[doc[[i for i, _ in each]]]
    counts = np.array([j - i for i, j in each], np.int32)
    data = [who.tobytes(), counts.tobytes(), start.astype(np.int32).tobytes(), None if length is None else length.astype(np.int32).tobytes(), *(h.tobytes() for h in hashes)]
    data += [None] * (6 - len(data))
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=[str(i) for i in range(7)])


def repeated_starts(docs: DataFrame, k: int = WINDOW, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """(doc_id, key, ranges): first words of windows of ``k`` words that start anywhere else as well."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size // 5

    def all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        hasher = WordHasher()
        for _, _, texts in slices(batches):
            yield hasher.windows(*hasher.words([t.encode() for t in texts]), k)[0]

    sketch = spark.sparkContext.broadcast(repeated_hashes(keyed, all_windows, expected))
    shards = max(16, -(-expected // shard_windows))
    buckets = max(16, -(-size // BUCKET_BYTES))

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, repeated = WordHasher(second=True), sketch.value
        held: list[tuple[np.ndarray, ...]] = []
        names: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h1, h2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((start, doc, h2, h1))
            h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            after = np.concatenate([[False], same])  # equals the window before it
            among = after | np.concatenate([same, [False]])
            who = np.array(names, np.int64)
            # Settled here: every window with an equal one in this task.
            if among.any():
                of, first, length = merged(doc[among], start[among], np.ones(int(among.sum()), np.int64))
                for x, y in runs(of // 1000):
                    yield _block(int(who[of[x], 1]) % shards, who, of[x:y], first[x:y], length[x:y])
            # Handed on: one window of each kind; those already settled have no start to be told about.
            i = np.flatnonzero(~after)
            place, shard = np.where(among[i], -1, start[i]), (h1[i] % np.uint64(shards)).astype(np.int64)
            j = np.lexsort((place, doc[i], shard))
            i, shard, place = i[j], shard[j], place[j]
            for x, y in runs(shard):
                yield _block(int(shard[x]), who, doc[i[x:y]], place[x:y], None, h1[i[x:y]], (h2[i[x:y]] >> np.uint64(32)).astype(np.uint32))

        for ids, keys, texts in slices(batches):
            first, other, at, docs_of = hasher.both([t.encode() for t in texts], k)
            keep = repeated(first)
            at = at[keep]
            begin = np.searchsorted(docs_of, np.arange(len(texts)))
            doc = docs_of[at]
            held.append((first[keep], other[keep], doc + len(names), at - begin[doc]))
            names.extend((NO_ID if d is None else d, key) for d, key in zip(ids, keys, strict=True))
            count += len(at)
            if count >= FLUSH:
                yield from flush()
                held, names, count = [], [], 0
        if count:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Ranges(buckets)
        names, h1, h2, doc, start = [], [], [], [], []
        n = 0
        for batch in batches:
            for who, counts, s, length, a, b in zip(*(batch.column(i) for i in range(1, 7)), strict=True):
                who, of = unpack(who, counts)
                s = np.frombuffer(s.as_buffer(), np.int32)
                if length.is_valid:
                    yield from found.add(who, of, s, np.frombuffer(length.as_buffer(), np.int32))
                    continue
                names.append(who)
                doc.append(of + n)
                n += len(who)
                start.append(s)
                h1.append(np.frombuffer(a.as_buffer(), np.uint64))
                h2.append(np.frombuffer(b.as_buffer(), np.uint32))
        if names:
            names, h1, h2, doc, start = (np.concatenate(x) for x in (names, h1, h2, doc, start))
            order = np.lexsort((h2, h1))
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            i = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            i = i[start[i] >= 0]
            yield from found.add(names, doc[i], start[i])
        yield from found.blocks()

    return by_document(keyed.mapInArrow(flagged, RECORD).repartition("shard").mapInArrow(settle, BLOCK))


def _with_ranges(docs: DataFrame, k: int) -> DataFrame:
    found = repeated_starts(docs, k).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "ranges")
    return _keyed(docs).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("doc_id", "ranges", "text")


def _kept_words(text: str, ranges: bytes | None, k: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.encode().split()
    if not ranges:
        return words, len(words)
    return [words[i] for i in np.flatnonzero(~covered(ranges, len(words), k)).tolist()], len(words)


def dedup_substrings(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each word covered by a repeated window of ``k`` words is removed.

    Windows are judged on the input. Rows are documents of their own, also where they share a doc_id or are equal (equal
    rows repeat each other); a null text has no words, a null doc_id stays null, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ranges, texts in slices(batches):
            kept = [_kept_words(t, r, k) for t, r in zip(texts, ranges, strict=True)]
            out = [b" ".join(w).decode() for w, _ in kept]
            n = [n for _, n in kept]
            removed = [n - len(w) for w, n in kept]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, n, removed)), pa.array(out, pa.string())], names=["0", "1", "2", "3"])

    return _with_ranges(docs, k).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
