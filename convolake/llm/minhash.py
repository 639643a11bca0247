"""Near duplicates: one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

Documents with equal shingle sets are one node. A node's signature is one hash value per bin of the hash range; empty
bins borrow from bins that a fixed random sequence of probes finds. Nodes that agree in a band meet in a bucket. In each
round a bucket compares its members with few hubs instead of each other; links are confirmed on the full sets, and
members that a component already joins need no further comparison. Hubs leave their bucket, so that the rounds end when
every bucket is one component or every pair of it has been compared: nothing that the buckets hold is lost. The number
of hubs grows eightfold from round to round, so that the number of rounds grows with the logarithm of a bucket.

Documents that only share a frequent passage also meet in crowded buckets, without links that would join them. So after
the first round the members of buckets still open are put into buckets anew, by the rarest shingles of their sets: the first
shingle that two similar sets have in common must come early in both. That loses no pair, and shared passages do not
bring documents together any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import id_and_text, slices, written
from convolake.llm.graph import components
from convolake.llm.words import WordHasher, mix

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4  # a pair at the threshold is missed with probability (1 - 0.75 ** 4) ** 32 < 1e-5
BINS_LOG = 7


class Shingles:
    """Sorted distinct shingle hashes per document; texts with fewer words than a shingle are one shingle."""

    def __init__(self, k: int = WORDS):
        self.k, self.hasher = k, WordHasher()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        hashes, docs = self.hasher.words([t.encode().lower() for t in texts])
        windows, at = self.hasher.windows(hashes, docs, self.k)
        n_words = np.bincount(docs, minlength=len(texts))
        ends = np.cumsum(n_words)
        bounds = np.searchsorted(at, np.concatenate([[0], ends]))
        out = []
        for i, n in enumerate(n_words.tolist()):
            if n >= self.k:
                out.append(np.unique(windows[bounds[i] : bounds[i + 1]]))
            else:
                total = np.full(min(n, 1), n, np.uint64)
                for j in range(ends[i] - n, ends[i]):
                    total = mix(total * np.uint64(31) + hashes[j] + np.uint64(7))
                out.append(total)
        return out


class Signatures:
    def __init__(self, bins_log: int = BINS_LOG, bands: int = BANDS, rows: int = ROWS):
        self.bins, self.bands, self.rows = 1 << bins_log, bands, rows
        self.edges = np.arange(self.bins, dtype=np.uint64) << np.uint64(64 - bins_log)
        self.tops = np.append(self.edges[1:] - np.uint64(1), np.uint64(2**64 - 1))

    def probe(self, bins: np.ndarray, attempt: int) -> np.ndarray:
        x = bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((attempt + 1) * 0x632BE59BD9B4E019 % 2**64)
        return (mix(x) % np.uint64(self.bins)).astype(np.int64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """A hash per band of a sorted, not empty set."""
        first = np.searchsorted(shingles, self.edges)
        inside = np.minimum(first, len(shingles) - 1)
        full = (first < len(shingles)) & (shingles[inside] <= self.tops)
        values = shingles[inside]
        empty, attempt = np.flatnonzero(~full), 0
        while len(empty):
            at = self.probe(empty, attempt)
            found = full[at]
            values[empty[found]] = values[at[found]]
            empty, attempt = empty[~found], attempt + 1
        rows = values[: self.bands * self.rows].reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
        return out


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set and the hashes of the bands (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sign = Shingles(k), Signatures()
        for ids, texts in slices(batches):
            sets = shingles(texts)
            with np.errstate(over="ignore"):
                one = [int(s.sum(dtype=np.uint64)) - 2**63 for s in sets]
                two = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - 2**63 for s in sets]
            bands = [sign(s).view(np.int64).tolist() if len(s) else None for s in sets]
            columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], one, two))]
            columns.append(pa.array(bands, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["0", "1", "2", "3", "4"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for ids, texts in slices(batches):
            sets = [s.tobytes() for s in shingles(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["0", "1"])

    return id_and_text(docs).mapInArrow(run, "node bigint, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def by_rarest(state: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``state`` with its nodes in a bucket for each of their rarest shingles that another node of ``state`` has too.

    Shingles are ordered by the number of these nodes that have them, then by value. ``left`` counts a node's shingles
    from that of the bucket on. Two sets share no more than the smaller ``left`` at the first shingle they have in common,
    so every pair to be found meets there with enough of it left, and the smaller set of the two is ``early``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
            if held:
                owners = np.repeat(batch.column(0).to_numpy(), [len(x) for x in held])
                yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate(held))], names=["node", "bucket"])

    nodes = state.select("node", "n", "weight", "comp").distinct()
    held = sets.join(nodes.select("node"), "node", "left_semi").select("node", "shingles").mapInArrow(run, "node bigint, bucket bigint")
    held = written(held, "held")
    often = held.groupBy("bucket").agg(F.count("*").alias("holders")).filter("holders > 1")
    of_node = Window.partitionBy("node")
    place = F.row_number().over(of_node.orderBy("holders", "bucket"))
    shared = held.join(often, "bucket").select("bucket", "node", place.alias("place"), F.count("*").over(of_node).alias("n_shared"))
    # Shingles of no other node come first and lead to nobody.
    met = shared.join(nodes, "node").withColumn("left", F.col("n_shared") - F.col("place") + 1)
    met = met.filter(100 * F.col("left") >= percent * F.col("n"))
    return met.withColumn("early", (100 + percent) * F.col("left") >= 2 * percent * F.col("n")).select(*state.columns)


def still_open(state: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, and a set that can be the smaller one of a pair."""
    several = state.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("early").alias("early"))
    several = several.filter("x <> y AND early").select("bucket")
    return state.join(several, "bucket")


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links lead to, ``kept`` whether it is the row's own. A null, empty or blank
    text has no shingles and is linked with nothing. Rows that share a doc_id count as one document with the links of
    all their texts. Rows without doc_id are linked with nothing, have no component and are kept. An empty table gives
    an empty result.
    """
    rows = written(signatures(docs, k), "signatures")
    nodes = written(
        rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("n_shingles", "h1", "h2")
        .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")),
        "nodes",
    )
    members = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").count().filter("count > 1").select("bucket")
    whole = {"comp": F.col("node"), "left": F.col("n"), "early": F.lit(True)}
    state = written(members.join(shared, "bucket").withColumns(whole), "buckets")
    # A document in the middle of its group shares the most crowded buckets; such members make the best hubs.
    crowd = state.groupBy("bucket").count().join(state, "bucket").groupBy("node").agg(F.sum("count").alias("weight"))
    state = written(state.join(crowd, "node"), "weighed")
    candidates = state.select("node").distinct()
    sets = written(
        shingle_sets(docs.select("doc_id", "text").join(candidates, F.col("doc_id") == F.col("node"), "left_semi"), k), "shingles"
    )

    smallest = tested = None
    hubs = 1
    while not state.isEmpty():
        one = ["bucket", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), F.col("left").alias("hub_left")]
        if hubs == 1:
            best = state.groupBy("bucket").agg(F.max(F.struct("weight", -F.col("node"))).alias("best"))
            best = best.select("bucket", (-F.col("best.col2")).alias("hub"))
            chosen = best.join(state.select(*one), ["bucket", "hub"])
        else:
            # Members of the smallest components come first: a bucket of one large component and few others ends at once.
            alike = state.groupBy("bucket", "comp").agg(F.count("*").alias("alike"))
            place = F.row_number().over(Window.partitionBy("bucket").orderBy("alike", F.desc("weight"), "node"))
            chosen = state.join(alike, ["bucket", "comp"]).withColumn("place", place).filter(F.col("place") <= hubs).select(*one)
        chosen = written(chosen, "hubs")
        enough = (100 + percent) * F.least("left", "hub_left") >= percent * (F.col("n") + F.col("hub_n"))
        pairs = (
            state.join(chosen, "bucket")
            .filter((F.col("node") != F.col("hub")) & (F.col("comp") != F.col("hub_comp")) & enough)
            .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = written(confirmed(pairs, sets, percent), "found")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if smallest is None or not found.isEmpty():
            smallest = components(found if smallest is None else smallest.unionByName(found))
        # What is left: members that were no hub, in buckets of more than one component.
        rest = (
            state.join(chosen.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti")
            .join(smallest.select(F.col("a").alias("node"), F.col("b").alias("least")), "node", "left")
            .select("bucket", "node", "n", "weight", "left", "early", F.coalesce("least", "node").alias("comp"))
        )
        state = written(still_open(written(rest, "rest")), "buckets")
        if hubs == 1:
            state = written(still_open(written(by_rarest(state, sets, percent), "rarest")), "buckets")
        hubs *= 8

    named = nodes.select("n_shingles", "h1", "h2", "node")
    if smallest is None:
        named = named.withColumn("component_id", F.col("node"))
    else:
        named = named.join(smallest.select(F.col("a").alias("node"), F.col("b").alias("least")), "node", "left").withColumn("component_id", F.coalesce("least", "node"))
    found = rows.join(named.select("n_shingles", "h1", "h2", "component_id"), ["n_shingles", "h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and rows without doc_id."""
    gone = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
