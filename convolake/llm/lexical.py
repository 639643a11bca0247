"""Ranked lexical search over an index whose documents are grouped by equal length normaliser m.

The index consists of segments of about equal size: ranges of m, cut further where many documents share one. A segment holds its documents in
the order of m and, per term, the postings ordered by stratum (one m) and falling tf, with the size of each group of equal
(m, tf). So the impact of a posting is computed once per group, and the first group of a stratum bounds what the term can
add there. A search first visits each segment's strata of highest bound, which gives every item a floor for its last
place; then all strata whose bound reaches the floor are visited in the order of their bounds, and the rest is skipped.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import id_and_text, slices, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
SEGMENT_BYTES = 32 << 20  # of text in a segment, about; a task holds the postings of one segment
CLASSES = 64  # classes of m to an octave, by which documents are dealt to segments
BLOCK_ITEMS = 2_000  # items of a block, about; a block is one search over the index
NO_ID = 2**63 - 1  # stands for a null doc_id: last among equal scores

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_POSTINGS = "segment int, term string, m array<bigint>, tf array<int>, size array<int>, docs array<int>, doc_ids array<bigint>"


@dataclass
class Index:
    """``table`` has one row per segment and term, and one per segment without term: m and doc_id of its documents."""

    table: DataFrame
    documents: int  # with at least one term
    segments: int

    @property
    def postings(self) -> DataFrame:
        return self.table.filter("term IS NOT NULL").drop("doc_ids")

    @property
    def members(self) -> DataFrame:
        return self.table.filter("term IS NULL")


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _segment(number: int, ids: np.ndarray, m: np.ndarray, lengths: np.ndarray, vocabulary: list[bytes], term: np.ndarray, tf: np.ndarray, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The rows of a segment: first its documents, then its terms in order. ``term`` and ``tf`` follow the documents."""
    names = _POSTINGS.replace(",", "").split()[::2]
    by_m = np.lexsort((ids, m))
    place = np.empty(len(ids), np.int32)
    place[by_m] = np.arange(len(ids))
    ids, m = ids[by_m], m[by_m]
    none = pa.nulls(1, pa.list_(pa.int32()))
    one = np.array([0, len(ids)])
    yield pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int32()), pa.nulls(1, pa.string()), _lists(m, one, pa.int64()), none, none, none, _lists(ids, one, pa.int64())], names=names
    )
    doc = np.repeat(place, lengths)
    alphabetic = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    rank = np.empty(len(vocabulary), np.int32)
    rank[alphabetic] = np.arange(len(vocabulary))
    term = rank[term]
    stratum = np.cumsum(np.diff(m, prepend=m[:1]) != 0)[doc]
    order = np.lexsort((doc, -tf, stratum, term))
    term, tf, doc, stratum = term[order], tf[order], doc[order], stratum[order]
    new = (np.diff(term, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0) | (np.diff(stratum, prepend=-1) != 0)
    group = np.append(np.flatnonzero(new), len(doc))
    size = np.diff(group)
    group = group[:-1]
    groups_to = np.searchsorted(term[group], np.arange(len(vocabulary) + 1))
    docs_to = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    for at in range(0, len(vocabulary), rows):
        end = min(len(vocabulary), at + rows)
        g, d = slice(groups_to[at], groups_to[end]), slice(docs_to[at], docs_to[end])
        by_group, by_doc = groups_to[at : end + 1] - groups_to[at], docs_to[at : end + 1] - docs_to[at]
        words = pa.array([vocabulary[i] for i in alphabetic[at:end]], pa.binary()).cast(pa.string())
        columns = [
            pa.array(np.full(end - at, number, np.int32)), words, _lists(m[doc[group[g]]], by_group, pa.int64()), _lists(tf[group[g]], by_group, pa.int32()),
            _lists(size[g].astype(np.int32), by_group, pa.int32()), _lists(doc[d], by_doc, pa.int32()), pa.nulls(end - at, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


class _Postings:
    """The postings of a segment's documents as they come."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.m, self.lengths, self.term, self.tf = array("q"), array("q"), array("i"), array("i"), array("i")

    def add(self, ids: list[int | None], m: list[int], texts: list[str]) -> None:
        self.ids.extend(NO_ID if i is None else i for i in ids)
        self.m.extend(m)
        for text in texts:
            counts = Counter(terms(text.encode()))
            self.lengths.append(len(counts))
            self.term.extend([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in counts])
            self.tf.extend(counts.values())

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        ids, m, lengths, term, tf = (np.frombuffer(a, a.typecode) for a in (self.ids, self.m, self.lengths, self.term, self.tf))
        yield from _segment(number, ids, m, lengths, list(self.vocabulary), term, tf)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> Index:
    """The index of all documents with at least one term. Every row is a document, rows that share a doc_id too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(2)]
            found = [pa.array([f(t) for t in texts], pa.int64()) for f in (lambda t: len(terms(t)), len)]
            yield pa.RecordBatch.from_arrays([*found, *batch.columns], names=["n", "size", "doc_id", "deal", "text"])

    rows = id_and_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("deal"), "text")
    rows = written(rows.mapInArrow(count, "n bigint, size bigint, doc_id bigint, deal bigint, text string").filter("n > 0"), "counted")
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    m = F.expr(f"100 - 90 + (90L * n * {total.docs}L) div {total.terms or 1}L")
    class_of = F.floor(CLASSES * F.log2(F.col("m").cast("double"))).cast("int")
    counted = rows.withColumn("m", m).withColumn("class", class_of)
    # Bytes per class of m (CLASSES to an octave, some thousands at most) tell which segments a class goes to.
    sizes = sorted(map(tuple, counted.groupBy("class").agg(F.sum("size")).collect()))
    places, at = [], 0
    for number, size in sizes:
        places.append((number, at // segment_bytes, (at + size - 1) // segment_bytes - at // segment_bytes + 1))
        at += size
    segments = max(1, math.ceil(at / segment_bytes))
    table = F.broadcast(docs.sparkSession.createDataFrame(places, "class int, first bigint, several bigint"))
    dealt = (
        counted.join(table, "class")
        .select((F.col("first") + F.pmod("deal", "several")).cast("int").alias("segment"), "doc_id", "m", "text")
        .repartitionById(segments, "segment")
        .sortWithinPartitions("segment")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for segment, *columns in slices(batches):
            # A slice may hold the end of one segment and the beginning of the next.
            at = 0
            while at < len(segment):
                end = at + segment[at:].count(segment[at])
                if segment[at] != now:
                    if now is not None:
                        yield from held.rows(now)
                    now, held = segment[at], _Postings()
                held.add(*(c[at:end] for c in columns))
                at = end
        if now is not None:
            yield from held.rows(now)

    return Index(written(dealt.mapInArrow(run, _POSTINGS), "index"), total.docs, segments)


def weighted_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(item_id, term, w) for the terms of each item that some document holds. Rows that share an item_id are one item."""
    lowered = F.translate("text", UPPER, LOWER)
    asked = queries.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    held = index.postings.select("term", F.size("docs").alias("df")).join(asked.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2.0 * F.col("df") + 1)))
    return asked.join(df, "term").select("item_id", "term", w.cast("bigint").alias("w"))


class _Term:
    """The postings of a term in a segment, with the impact of each group."""

    def __init__(self, m: np.ndarray, tf: np.ndarray, size: np.ndarray, docs: np.ndarray, strata: np.ndarray):
        tf = tf.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        first = np.flatnonzero(np.diff(m, prepend=-1))
        self.strata = np.searchsorted(strata, m[first])
        self.bound = impact[first]
        ends = np.cumsum(size)
        self.to = np.append((ends - size)[first], ends[-1])
        self.docs, self.impact = docs, np.repeat(impact, size)

    def within(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the postings in the wanted strata (ascending)."""
        at = np.searchsorted(self.strata, wanted)
        held = at < len(self.strata)
        at = at[held][self.strata[at[held]] == wanted[held]]
        start, n = self.to[at], self.to[at + 1] - self.to[at]
        return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _best(scores: np.ndarray, docs: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Of the documents, those with the highest scores, equal ones by smallest id."""
    if len(docs) > top:
        docs = docs[scores[docs] >= np.partition(scores[docs], len(docs) - top)[len(docs) - top]]
    return docs[np.lexsort((ids[docs], -scores[docs]))][:top]


def _search(asked: list[tuple[_Term, int]], ids: np.ndarray, to: np.ndarray, floor: int, top: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of the best documents of a segment, whole for scores from ``floor`` on unless ``once``.

    ``to`` has the first document of each stratum and the number of documents.
    """
    bound = np.zeros(len(to) - 1, np.int64)
    for term, w in asked:
        bound[term.strata] += w * term.bound
    order = np.argsort(-bound, kind="stable")
    order = order[: np.searchsorted(-bound[order], 0)]  # strata that can score at all
    scores, best = np.zeros(len(ids), np.int64), np.empty(0, np.int64)
    at, step = 0, max(1, int(np.searchsorted(np.cumsum(np.diff(to)[order]), top)) + 1)
    while at < len(order) and bound[order[at]] >= floor:
        visit = order[at : at + step]
        visit = np.sort(visit[bound[visit] >= floor])
        seen = [best]
        for term, w in asked:
            places = term.within(visit)
            docs = term.docs[places]
            scores[docs] += w * term.impact[places]
            seen.append(docs)
        docs = np.unique(np.concatenate(seen))
        best = _best(scores, docs[scores[docs] > 0], ids, top)
        if once:
            break
        if len(best) == top:
            floor = max(floor, int(scores[best[-1]]))
        at, step = at + step, 2 * step
    return best, scores[best]


def _visit(index: Index, held: DataFrame, items: DataFrame, top: int, once: bool) -> DataFrame:
    """(item_id, doc_id, score) from every segment; ``items`` has the floor of each."""

    def run(key: tuple, segment: pa.Table, items: pa.Table) -> pa.Table:
        found: list[tuple] = []
        postings: dict[str, _Term] = {}
        ids = to = strata = None
        for batch in segment.to_batches():
            for i in np.flatnonzero(np.asarray(batch.column("term").is_null())).tolist():
                ids, m = (np.asarray(batch.column(c)[i].values) for c in ("doc_ids", "m"))
                strata, to = np.unique(m, return_index=True)
                to = np.append(to, len(m))
        for batch in segment.to_batches():
            names, columns = batch.column("term").to_pylist(), [batch.column(c) for c in ("m", "tf", "size", "docs")]
            for i, name in enumerate(names):
                if name is not None:
                    postings[name] = _Term(*(np.asarray(c[i].values) for c in columns), strata)
        for item, floor, words, ws in zip(*(items.column(c).to_pylist() for c in ("item_id", "floor", "terms", "ws")), strict=True) if postings else ():
            asked = [(postings[t], w) for t, w in zip(words, ws, strict=True) if t in postings]
            docs, scores = _search(asked, ids, to, floor, top, once)
            found += [(item, None if i == NO_ID else i, s) for i, s in zip(ids[docs].tolist(), scores.tolist(), strict=True)]
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    asked = items.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(index.segments - 1))))
    left = held.repartition(index.segments, "segment").groupBy("segment")
    right = asked.repartition(index.segments, "segment").groupBy("segment")
    return left.cogroup(right).applyInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: Index, queries: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above zero.

    Equal scores are ranked by doc_id, a null one last; which of several rows with the same doc_id and score comes first
    does not show. Rows that share an item_id (a null one too) are one item; an item without terms, or whose terms no
    document holds, has no rows. Empty tables give an empty result. Items go in blocks: what a task holds of them and of
    their postings is bounded whatever the number of items.
    """
    weights = written(weighted_terms(index, queries), "weights")
    items = weights.select("item_id").distinct().count()
    blocks = max(1, math.ceil(items / block_items))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for number in range(blocks):
        asked = weights.filter(block == number)
        held = index.postings.join(asked.select("term").distinct(), "term", "left_semi").select("segment", "term", "m", "tf", "size", "docs")
        members = index.members.select("segment", "term", "m", "tf", "size", "docs", "doc_ids")
        held = written(members.unionByName(held, allowMissingColumns=True), "held")
        packed = asked.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("asked")).select("item_id", F.col("asked.term").alias("terms"), F.col("asked.w").alias("ws"))
        packed = written(packed, "items")
        first = _ranked(_visit(index, held, packed.withColumn("floor", F.lit(1).cast("bigint")), top, True), top)
        floors = first.filter(F.col("rank") == top).select(F.col("item_id").alias("of"), F.col("score").alias("floor"))
        ready = packed.join(floors, F.col("item_id").eqNullSafe(F.col("of")), "left").select("item_id", "terms", "ws", F.coalesce("floor", F.lit(1)).alias("floor"))
        part = _ranked(_visit(index, held, written(ready, "floors"), top, False), top).select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found
