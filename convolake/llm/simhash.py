"""SimHash near duplicates: fingerprints of word shingles, linked by a self-join of their binary trie.

The trie of the distinct fingerprints is walked in pairs of nodes from the pair (root, root) down: a pair goes on with
those pairs of its children whose prefixes differ in no more bits than the budget allows. The upper part of the walk is
a DataFrame of node pairs, until the two nodes of a pair hold few enough fingerprints for one task; there the walk goes on,
depth first with a bounded frontier. A pair of subtries gives a spanning forest of its links, not the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import id_and_text, slices, written
from convolake.llm.graph import components

WORDS = 3
SEED = 42
BUDGET = 3  # bits in which linked fingerprints may differ
LEAF = 40_000  # fingerprints below the two nodes of a pair that a task walks alone
STEP = 2  # levels of the trie per round of the upper walk
TASK = 250_000  # fingerprints read by a task of the lower walk, about
FRONTIER = 1 << 18  # node pairs expanded at once
HOT = 10_000  # fingerprints with at least 1 / HOT of all rows meet their component by a broadcast of at most HOT rows

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ONES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> None:
    """Adds the set bits of each hash to the 64 counters of its document; ``docs`` is ascending."""
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    lengths = np.diff(first, append=len(docs))
    # At most 255 hashes to a sum, so that eight counters of eight bits fit into one word.
    parts = -(-lengths // 255)
    start = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    of_doc = np.cumsum(parts) - parts
    for shift in range(8):
        sums = np.add.reduceat(hashes >> np.uint64(shift) & _ONES, start)
        per_doc = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), of_doc, axis=0, dtype=np.int64)
        counts[docs[first], shift::8] += per_doc


def _fingerprints(texts: list[bytes], k: int, chunk: int = 1 << 16) -> np.ndarray:
    """The fingerprint of each lower-cased text."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    # One space between words, so that a shingle is a slice.
    keep = ~space
    keep[1:] |= ~space[:-1] & space[1:]
    clean = np.where(space, np.uint8(32), data)[keep].tobytes()
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    docs = np.searchsorted(np.cumsum([1] + [len(t) + 1 for t in texts]), starts, "right") - 1
    n_words = np.bincount(docs, minlength=len(texts))
    stop = np.cumsum(ends - starts + 1) - 1
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop

    word = np.arange(len(docs))
    whole = np.cumsum(n_words) - n_words  # first word of each document
    last = np.minimum(word + k - 1, (whole + n_words)[docs] - 1)
    use = (last == word + k - 1) | ((word == whole[docs]) & (n_words[docs] < k))
    begin, stop, docs = begin[use], stop[last[use]], docs[use]

    counts = np.zeros((len(texts), 64), np.int64)
    view, digest = memoryview(clean), xxhash.xxh64_intdigest
    for at in range(0, len(docs), chunk):
        i, j = begin[at : at + chunk].tolist(), stop[at : at + chunk].tolist()
        hashes = np.fromiter((digest(view[x:y], SEED) for x, y in zip(i, j, strict=True)), np.uint64, len(i))
        _bit_counts(hashes, docs[at : at + chunk], counts)
    total = np.bincount(docs, minlength=len(texts))
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint bigint) per row of ``docs``: bit i is set if it is in over half of the shingles' hashes.

    Words are lower-cased in A-Z; shingles count as often as they occur. Fewer than ``k`` words are one shingle, a null,
    empty or blank text has the fingerprint zero. Texts of any length are read whole, in chunks of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            found = _fingerprints([t.encode().lower() for t in texts], k).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], names=["0", "1"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, fingerprint bigint")


class _Trie:
    """The nodes of each level of the trie of a sorted array: first leaf, size and the two children (-1: none)."""

    def __init__(self, values: np.ndarray, level: int):
        self.values = values
        self.first, self.size, self.kids = {}, {}, {}
        starts, node = np.zeros(min(1, len(values)), np.int32), np.zeros(len(values), np.int32)
        for at in range(level, 65):
            self.first[at], self.size[at] = starts, np.diff(starts, append=len(values))
            if at == 64 or len(starts) == len(values):  # single leaves only
                return
            prefix = values >> np.uint64(63 - at)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            below = np.flatnonzero(new).astype(np.int32)
            kids = np.full((len(starts), 2), -1, np.int32)
            kids[node[below], (prefix[below] & np.uint64(1)).astype(np.int64)] = np.arange(len(below), dtype=np.int32)
            self.kids[at] = kids
            starts, node = below, (np.cumsum(new) - 1).astype(np.int32)


def _walk(x: _Trie, y: _Trie, level: int, budget: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves (of x, of y) with fingerprints that differ in at most ``budget`` bits; x and y may be the same trie."""
    same = x is y
    if not len(x.values) or not len(y.values):
        return
    differ = int(x.values[0] >> np.uint64(64 - level) ^ y.values[0] >> np.uint64(64 - level)).bit_count() if level else 0
    if differ > budget:
        return
    zero = np.zeros(1, np.int32)
    todo = [(level, zero, zero, np.full(1, differ, np.int8))]
    while todo:
        at, a, b, d = todo.pop()
        if len(a) > frontier:
            todo.append((at, a[frontier:], b[frontier:], d[frontier:]))
            a, b, d = a[:frontier], b[:frontier], d[:frontier]
        x_at, y_at = min(at, max(x.first)), min(at, max(y.first))  # below its last level a trie has single leaves
        lone = (x.size[x_at][a] == 1) & (y.size[y_at][b] == 1)
        if lone.any():
            i, j = x.first[x_at][a[lone]], y.first[y_at][b[lone]]
            near = np.bitwise_count(x.values[i] ^ y.values[j]) <= budget
            if same:
                near &= i != j
            if near.any():
                yield i[near], j[near]
            a, b, d = a[~lone], b[~lone], d[~lone]
        if not len(a):
            continue
        x_kids, y_kids = _children(x, at, a), _children(y, at, b)
        out = []
        for i in (0, 1):
            for j in (0, 1):
                p, q = x_kids[i], y_kids[j]
                good = (p >= 0) & (q >= 0)
                if i != j:
                    good &= d < budget
                if same and i > j:
                    good &= a != b
                out.append((p[good], q[good], d[good] + np.int8(i != j)))
        todo.append((at + 1, *(np.concatenate(c) for c in zip(*out, strict=True))))


def _children(trie: _Trie, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if level in trie.kids:
        kids = trie.kids[level][nodes]
        return kids[:, 0], kids[:, 1]
    bit = (trie.values[nodes] >> np.uint64(63 - level)) & np.uint64(1)  # a node is a single leaf here
    none = np.full(len(nodes), -1, np.int32)
    return np.where(bit == 0, nodes, none), np.where(bit == 1, nodes, none)


class _Forest:
    """Links among n things, held as the smallest thing each leads to."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _prefix(fingerprint: str, level: Column | int) -> Column:
    """The first ``level`` bits; a shift by 64 would be one by 0."""
    if isinstance(level, int):
        return F.expr(f"shiftrightunsigned({fingerprint}, {64 - level})") if level else F.lit(0).cast("bigint")
    return F.when(level == 0, F.lit(0).cast("bigint")).otherwise(F.expr(f"shiftrightunsigned({fingerprint}, 64 - level)"))


def subtrie_pairs(nodes: DataFrame, budget: int = BUDGET, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """(level, p, q, size): pairs of trie nodes, p <= q, that hold at most ``leaf`` fingerprints and cover all links."""
    spark = nodes.sparkSession
    level, closed = 0, []
    total = nodes.count()
    now = spark.createDataFrame([(0, 0, total, total)], "p bigint, q bigint, m bigint, n bigint")
    while True:
        size = F.when(F.col("p") == F.col("q"), F.col("m")).otherwise(F.col("m") + F.col("n"))
        small = (size <= leaf) | F.lit(level >= 64)
        closed.append(now.filter(small).select(F.lit(level).alias("level"), "p", "q", size.alias("size")))
        large = now.filter(~small).select("p", "q")
        if level >= 64 or large.isEmpty():
            break
        below = min(64, level + step)
        held = large.select(F.col("p").alias("x")).unionByName(large.select(F.col("q").alias("x"))).distinct()
        kids = (
            nodes.select(_prefix("fingerprint", level).alias("x"), _prefix("fingerprint", below).alias("kid"))
            .join(held, "x", "left_semi").groupBy("x", "kid").count()
        )
        left = kids.select(F.col("x").alias("p"), F.col("kid").alias("a"), F.col("count").alias("m"))
        right = kids.select(F.col("x").alias("q"), F.col("kid").alias("b"), F.col("count").alias("n"))
        pairs = large.join(left, "p").join(right, "q").filter((F.col("a") <= F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget))
        now = written(pairs.select(F.col("a").alias("p"), F.col("b").alias("q"), "m", "n"), "trie")
        level = below
    found = closed[0]
    for part in closed[1:]:
        found = found.unionByName(part)
    return found


def links(nodes: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(a, b) fingerprints, b < a in the trie's order: a spanning forest of the links below each pair of subtries."""
    pairs = written(subtrie_pairs(nodes, budget, leaf), "subtries")
    levels = [r.level for r in pairs.select("level").distinct().collect()]  # 64 / STEP + 1 at most
    size = pairs.agg(F.sum("size")).first()[0] or 0
    sides = pairs.select("level", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("x"))
    level = F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))
    blocks = (
        nodes.select("fingerprint", level.alias("level")).select("level", _prefix("fingerprint", F.col("level")).alias("x"), "fingerprint")
        .join(sides.select("level", "x").distinct(), ["level", "x"], "left_semi")
        .groupBy("level", "x").agg(F.collect_list("fingerprint").alias("fingerprints"))
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        held = [np.sort(f.values.to_numpy().view(np.uint64)) for f in table.column("fingerprints")]
        tries = [_Trie(v, key[0].as_py()) for v in held]
        values = np.concatenate(held)
        forest, other = _Forest(len(values)), len(held[0]) if len(held) > 1 else 0
        for i, j in _walk(tries[0], tries[-1], key[0].as_py(), budget):
            forest.link(i.astype(np.int64), j.astype(np.int64) + other)
        a = np.flatnonzero(forest.root != np.arange(len(values)))
        return pa.table({"a": values[a].view(np.int64), "b": values[forest.root[a]].view(np.int64)})

    units = sides.join(blocks, ["level", "x"]).repartition(max(1, -(-size // TASK)), "level", "p", "q")
    return units.select("level", "p", "q", "fingerprints").groupBy("level", "p", "q").applyInArrow(run, "a bigint, b bigint")


def near_fingerprints(docs: DataFrame, k: int = WORDS, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest doc_id that links of at most ``budget`` differing bits lead to. Equal fingerprints are
    linked, those of empty texts (zero) too. Rows that share a doc_id are linked with each other; rows without doc_id are
    linked with nothing and have no component. An empty table gives an empty result; other columns are ignored.
    """
    rows = written(fingerprints(docs, k), "fingerprints")
    nodes = written(
        rows.filter("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "nodes"
    )
    of_id = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("x"))
    several = of_id.filter("b <> x").select("doc_id", "b")
    same_id = rows.join(several, "doc_id").select(F.col("fingerprint").alias("a"), "b").filter("a <> b").distinct()
    found = written(links(nodes, budget, leaf).unionByName(same_id), "links")
    roots = components(found).select(F.col("a").alias("fingerprint"), F.col("b").alias("root"))
    rooted = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = written(rooted.join(least, "root").select("fingerprint", "n", "component_id"), "named")

    total = named.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(named.filter(F.col("n") >= max(1000, -(-total // HOT))).select("fingerprint", "component_id"))
    rare = rows.join(often.select("fingerprint"), "fingerprint", "left_anti").join(named.drop("n"), "fingerprint", "left")
    known = rows.join(often, "fingerprint").unionByName(rare)
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return known.select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
