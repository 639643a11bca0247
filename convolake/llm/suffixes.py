"""Repeated byte strings by merging the Burrows-Wheeler transforms of shards.

Every string of ``LENGTH`` bytes is led to a shard by its smallest ``ANCHOR``-byte part, so that equal strings meet. The
strings that share an anchor occurrence are one segment of the text. Anchors that a merged sketch takes for single are
left out, and equal segments collapse before and after they are sent; what remains are segments that agree in part. Strings
that a count among them takes for single are left out of these, and what stays is ordered exactly: the
shards are sorted apart and merged by iterative interleave refinement: a round parts the interleaving by the preceding
byte (a stable counting sort) and so orders all suffixes by one byte more, without sorting suffixes again. Where a round
opens a boundary the common prefix ends; suffixes without a boundary after ``LENGTH`` rounds form a repeated interval,
of which the earliest string stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import slices, text_key
from convolake.llm.ranges import BLOCK, BUCKET_BYTES, NO_ID, Ranges, by_document, covered
from convolake.llm.sketch import repeated_hashes
from convolake.llm.words import _BYTES, Powers, mix, rolling

LENGTH = 100
ANCHOR = 64
SHARD_BYTES = 2 << 20  # of a shard that is sorted by itself
MERGE_BYTES = 256 << 10  # of shards merged with each other (they fit a core's cache), more only where a single anchor has more
SLICE_BYTES = 1_000_000  # of text hashed at once
SHARD_SEGMENTS = 100_000
FLUSH_BYTES = 24_000_000
POSITION_BITS = np.uint64(28)
_ODD = (0xB492B66FBE98F273, 0x9AE16A3B2F90404F)


class Segments:
    """Runs of neighbouring strings with the same anchor occurrence, of a slice of texts."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor = length, anchor
        self.near, self.far = Powers(_ODD[0]), Powers(_ODD[1])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(anchor hash, document, first string, strings, hash of the whole segment) of each run; the joined bytes and where documents begin."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        k, width = self.anchor, self.length - self.anchor + 1
        n = len(data) - self.length + 1
        none = np.empty(0, np.int64)
        if n <= 0:
            return np.empty(0, np.uint64), none, none, none, np.empty(0, np.uint64), data, begins
        values = _BYTES[data]
        sums, down = rolling(values, self.near)
        hashes = mix((sums[k:] - sums[:-k]) * down[: len(sums) - k])
        low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        covered = 1
        while covered < width:
            step = min(covered, width - covered)
            least = np.minimum(least[:-step], least[step:])
            covered += step
        at = (least[:n] & low).astype(np.int64)
        starts = np.arange(n)
        doc = np.repeat(np.arange(len(texts)), sizes)[:n]
        inside = starts + self.length <= (begins + sizes)[doc]
        starts, at, doc = starts[inside], at[inside], doc[inside]
        if not len(starts):
            return np.empty(0, np.uint64), none, none, none, np.empty(0, np.uint64), data, begins
        cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(doc) != 0)) + 1
        first = np.concatenate([[0], cuts])
        count = np.diff(np.concatenate([first, [len(starts)]]))
        begin, who = starts[first], doc[first]
        end = begin + count - 1 + self.length
        sums2, down2 = rolling(values ^ np.uint64(0x5851F42D4C957F2D), self.far)
        whole = mix((sums2[end] - sums2[begin]) * down2[begin] + count.astype(np.uint64))
        return hashes[at[first]], who, begin - begins[who], count, whole, data, begins


def shard_order(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, preceding bytes + 1 (0: none) in that order, and the segment of each suffix; ends sort by segment."""
    size = np.array([len(s) + 1 for s in segments], np.int64)
    ends = np.cumsum(size) - 1
    data = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
    n, m = len(data), len(segments)
    rank = data.astype(np.int64) + m
    rank[ends] = np.arange(m)
    step, longest = 1, int(size.max())
    places = np.arange(n)
    while True:
        key = rank * (n + 257) + rank[np.minimum(places + step, n - 1)]
        order = np.argsort(key)  # equal keys get equal ranks, in whatever order
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step > 2 * longest:
            break
    before = np.zeros(n, np.uint8)
    before[1:] = data[:-1] + np.uint8(1)  # no byte of UTF-8 is 255
    before[ends[:-1] + 1] = 0
    return order, before[order], np.repeat(np.arange(m), size)


def merge(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int, rounds: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaving (False: left) of two transforms, and the boundaries between suffixes that differ within ``depth`` bytes.

    ``left`` and ``right`` are preceding bytes in suffix order; the first ``n_left`` and ``n_right`` suffixes are ends.
    """
    n, ends = len(left) + len(right), n_left + n_right
    both, places = np.concatenate([left, right]), np.arange(n, dtype=np.int32)
    kinds = np.sort(both)[ends:]
    apart = np.ones(n, bool)  # the first bytes of suffixes are the same in all rounds
    apart[ends + 1 :] = kinds[1:] != kinds[:-1]
    from_right = np.concatenate([np.zeros(len(left), bool), np.ones(len(right), bool)])
    block = np.zeros(n, np.int32)
    found = None
    end_sides = np.concatenate([np.zeros(n_left, bool), np.ones(n_right, bool)])
    for i in range(1, rounds + 1):
        taken = np.cumsum(from_right, dtype=np.int32)
        symbols = both[np.where(from_right, taken + np.int32(len(left) - 1), places - taken)]
        order = np.argsort(symbols, kind="stable")[ends:]
        source = block[order]
        opened = apart.copy()
        opened[ends + 1 :] |= source[1:] != source[:-1]
        now = np.concatenate([end_sides, from_right[order]])
        block = np.cumsum(opened, dtype=np.int32)
        same, from_right = i >= depth and np.array_equal(now, from_right), now
        if i == depth:
            found = opened
        if i >= depth and (same or block[-1] == n):
            break
    return from_right, found if found is not None else opened


def repeated_intervals(segments: list[bytes], depth: int, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(interval, segment, offset) of all suffixes that share ``depth`` bytes with another one."""
    shards, held, size = [], [], 0
    limit = min(shard_bytes, max(1, sum(map(len, segments)) // 2 + 1))  # two shards at least: there is something to merge
    for s in segments:
        held.append(s)
        size += len(s)
        if size >= limit:
            shards.append(held)
            held, size = [], 0
    if held:
        shards.append(held)
    if len(shards) == 1 and len(segments) > 1:  # the last segment filled the only shard
        shards = [segments[:-1], segments[-1:]]
    built, begun = [], 0
    for held in shards:
        order, before, owner = shard_order(held)
        offset = np.arange(len(owner)) - np.concatenate([[0], np.cumsum([len(s) + 1 for s in held])])[owner]
        built.append((before, owner[order] + begun, offset[order], len(held), None))
        begun += len(held)
    rounds = max(map(len, segments)) + 2  # a full order, which later merges build on; the last one needs ``depth`` bytes
    while len(built) > 1:
        then = []
        for a, b in zip(built[::2], built[1::2], strict=False):
            side, opened = merge(a[0], b[0], a[3], b[3], depth if len(built) == 2 else rounds, depth)
            joined = []
            for x, y in zip(a[:3], b[:3], strict=True):
                z = np.empty(len(side), x.dtype)
                z[~side], z[side] = x, y
                joined.append(z)
            then.append((*joined, a[3] + b[3], opened))
        built = then + ([built[-1]] if len(built) % 2 else [])
    _, owner, offset, _, opened = built[0]
    if opened is None:
        return
    interval = np.cumsum(opened)
    shared = np.flatnonzero(np.bincount(interval)[interval] > 1)
    yield interval[shared], owner[shared], offset[shared]


def may_repeat(segments: list[bytes], depth: int, powers: Powers) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(part, segment, its offset there): of each segment what lies between strings of ``depth`` bytes that may be elsewhere too.

    Strings are counted by hashes in sixteen cells each or more. Equal ones share a cell, so none that repeats is cut off.
    """
    none = np.empty(0, np.int64)
    size = np.array([len(s) for s in segments], np.int64)
    begins = np.cumsum(size) - size
    data = b"".join(segments)
    n = len(data) - depth + 1
    if n <= 0:
        return [], none, none
    sums, down = rolling(_BYTES[np.frombuffer(data, np.uint8)], powers)
    owner = np.repeat(np.arange(len(segments)), size)
    at = np.flatnonzero(owner[:n] == owner[depth - 1 :])
    bits = (16 * len(at)).bit_length()
    cells = (mix((sums[at + depth] - sums[at]) * down[at]) >> np.uint64(64 - bits)).astype(np.int64) if len(at) else none
    at = at[np.bincount(cells)[cells] > 1] if len(at) else at
    if not len(at):
        return [], none, none
    new = owner[at[1:]] != owner[at[:-1]]
    first, last = at[np.concatenate([[True], new])], at[np.concatenate([new, [True]])]
    parts = [data[a : b + depth] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return parts, owner[first], first - begins[owner[first]]


def anchor_groups(segments: list[tuple[int, bytes, tuple]], size: int = MERGE_BYTES) -> Iterator[list[tuple[tuple, bytes]]]:
    """(place, segment) in lists of about ``size`` bytes; segments, ordered by anchor, stay with all others of their anchor."""
    held, n = [], 0
    for i, (a, segment, place) in enumerate(segments):
        if n >= size and a != segments[i - 1][0]:
            yield held
            held, n = [], 0
        held.append((place, segment))
        n += len(segment)
    if held:
        yield held


def repeated_strings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, key, ranges): strings of ``length`` bytes that also start earlier, as packed (first, how many) pairs, one row per document."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = 2 * size // (length - anchor + 2)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        cut = Segments(length, anchor)
        for _, _, texts in slices(batches, SLICE_BYTES):
            yield cut([t.encode() for t in texts])[0]

    sketch = docs.sparkSession.sparkContext.broadcast(repeated_hashes(keyed, anchors, 4 * expected))
    shards = max(24, -(-expected // SHARD_SEGMENTS))
    buckets = max(16, -(-size // BUCKET_BYTES))
    types = [pa.int32(), *[pa.binary()] * 6]

    def record(shard: int, *arrays: np.ndarray | bytes | None) -> pa.RecordBatch:
        data = [a if a is None or isinstance(a, bytes) else a.tobytes() for a in arrays]
        data += [None] * (6 - len(data))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([shard, *data], types, strict=True)], names=[str(i) for i in range(7)])

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, repeated = Segments(length, anchor), sketch.value
        held: list[tuple] = []
        names: list[tuple] = []
        chunks: list[bytes] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, who, start, count, whole, place = (np.concatenate(x) for x in zip(*held, strict=True))
            named, text = np.array(names, np.int64), b"".join(chunks)
            order = np.lexsort((start, named[who, 0], whole, h))
            h, who, start, count, whole, place = (x[order] for x in (h, who, start, count, whole, place))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            later = ~new & ((named[who, 0] != named[who[lead], 0]) | (start != start[lead]))
            if later.any():
                yield record(int(h[0] % np.uint64(shards)), named, who[later].astype(np.int32), start[later].astype(np.int32), count[later].astype(np.int32))
            i = np.flatnonzero(new)
            shard = (h[i] % np.uint64(shards)).astype(np.int64)
            i = i[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            for x, y in zip(np.searchsorted(shard, np.unique(shard)), np.searchsorted(shard, np.unique(shard), "right"), strict=True):
                j = i[x:y]
                used, local = np.unique(who[j], return_inverse=True)
                body = b"".join([text[p : p + c - 1 + length] for p, c in zip(place[j].tolist(), count[j].tolist(), strict=True)])
                yield record(int(shard[x]), named[used], local.astype(np.int32), start[j].astype(np.int32), count[j].astype(np.int32), h[j], body)

        for ids, keys, texts in slices(batches, SLICE_BYTES):
            h, who, start, count, whole, data, begins = cut([t.encode() for t in texts])
            keep = repeated(h)
            h, who, start, count, whole = (x[keep] for x in (h, who, start, count, whole))
            held.append((h, who + len(names), start, count, whole, begins[who] + start + total))
            names.extend((NO_ID if d is None else d, k) for d, k in zip(ids, keys, strict=True))
            chunks.append(data.tobytes())
            total += len(data)
            if total >= FLUSH_BYTES:
                yield from flush()
                held, names, chunks, total = [], [], [], 0
        if held and total:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Ranges(buckets)
        kept: dict[tuple[int, bytes], tuple] = {}  # earliest place of each segment
        done_names, done = [], []

        def finish() -> Iterator[pa.RecordBatch]:
            pairs = np.array(done, np.int64).reshape(-1, 2)
            yield from found.add(np.array(done_names, np.int64).reshape(-1, 2), np.arange(len(done)), pairs[:, 0], pairs[:, 1])
            done_names.clear()
            done.clear()

        for batch in batches:
            for named, who, start, count, h, body in zip(*(batch.column(i) for i in range(1, 7)), strict=True):
                named = np.frombuffer(named.as_buffer(), np.int64).reshape(-1, 2)
                who, start, count = (np.frombuffer(x.as_buffer(), np.int32) for x in (who, start, count))
                if not h.is_valid:
                    yield from found.add(named, who, start, count)
                    continue
                body, at = body.as_py(), 0
                names = [tuple(x) for x in named.tolist()]
                for a, w, s, c in zip(np.frombuffer(h.as_buffer(), np.uint64).tolist(), who.tolist(), start.tolist(), count.tolist(), strict=True):
                    segment = body[at : at + c - 1 + length]
                    at += len(segment)
                    place, old = (names[w], s), kept.get((a, segment))
                    if old is None or (place[0][0], s) < (old[0][0], old[1]):
                        kept[a, segment] = place
                        old, place = place, old
                    if place is not None and (place[0][0], place[1]) != (old[0][0], old[1]):
                        done_names.append(place[0])
                        done.append((place[1], c))
                if len(done) > 100_000:
                    yield from finish()
        times: dict[int, int] = {}
        for a, _ in kept:
            times[a] = times.get(a, 0) + 1
        partly = sorted((a, segment, place) for (a, segment), place in kept.items() if times[a] > 1)
        kept.clear()
        times.clear()
        powers = Powers(_ODD[0])
        for group in anchor_groups(partly):
            own = np.array([p[0] for p, _ in group], np.int64)
            first = np.array([p[1] for p, _ in group], np.int64)
            parts, of, shift = may_repeat([s for _, s in group], length, powers)
            if not parts:
                continue
            for interval, owner, offset in repeated_intervals(parts, length):
                owner, offset = of[owner], shift[owner] + offset
                ids, start = own[owner, 0], first[owner] + offset
                order = np.lexsort((start, ids, interval))
                interval, owner, ids, start = interval[order], owner[order], ids[order], start[order]
                new = np.concatenate([[True], interval[1:] != interval[:-1]])
                lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                later = (ids != ids[lead]) | (start != start[lead])
                yield from found.add(own, owner[later], start[later])
        yield from finish()
        yield from found.blocks()

    blocks = keyed.mapInArrow(flagged, "shard int, names binary, who binary, starts binary, counts binary, anchors binary, body binary").repartition(
        "shard"
    ).mapInArrow(settle, BLOCK)
    return by_document(blocks)


def _kept_bytes(data: bytes, ranges: bytes | None, length: int) -> tuple[bytes, int]:
    """The bytes that stay, and the number of removed runs."""
    if not ranges:
        return data, 0
    gone = covered(ranges, len(data), length)
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), spans


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, carry: tuple = ()) -> DataFrame:
    """doc_id, n_bytes, n_spans, kept (the bytes that stay), kept_text and the columns named in ``carry``.

    kept_text is the text of the bytes that stay; parts of characters that were cut through are left out of it.

    Each byte covered by a string of ``length`` bytes that also starts earlier (smaller doc_id, or same document and
    earlier start) is removed; strings are judged on the input and never cross documents. Rows that share a doc_id are
    the same place twice: neither is earlier. A null doc_id comes first, a null text is empty, an empty table gives an
    empty result.
    """
    found = repeated_strings(docs, length).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "ranges")
    row = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("_none")]).alias("_row")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row, text.alias("text"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ranges, data in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = data.as_py().encode()
                kept, runs = _kept_bytes(data, ranges, length)
                rows.append((len(data), runs, kept, kept.decode(errors="ignore")))
            n, runs, kept, left = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "n_bytes", "n_spans", "kept", "kept_text"])

    kind = keyed.schema["_row"].dataType.simpleString()
    out = joined.select("doc_id", "_row", "ranges", "text").mapInArrow(run, f"doc_id bigint, _row {kind}, n_bytes bigint, n_spans bigint, kept binary, kept_text string")
    return out.select("doc_id", "n_bytes", "n_spans", "kept", "kept_text", *[f"_row.{c}" for c in carry])


def digest(kept: DataFrame) -> DataFrame:
    removed = F.col("n_bytes") - F.octet_length("kept")
    return kept.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
