"""The trie of conversation prefixes, with totals over subtrees by centroid decomposition.

A prefix is named by its depth and the exclusive or of hashes of (position, role, text), so that prefixes come from a
running aggregate that stays parallel inside a long conversation. A node is also named by its smallest member and its
depth; the path of that member tells all its ancestors.

Subtree totals: every component of the parent-edge forest is split at its centroid. The total of the part below the
centroid is added to the nodes from the centroid up to the component's top, then the centroid goes, its children become
tops of their own, and the rest goes on above. Components too large for a task are split so by joins, all of them in
one round; the others are settled inside tasks in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import met, written

SPAN = 1024  # turns of a conversation that one window scans
LEAST_PART = 20_000  # nodes of a component settled inside a task, at least
MOST_PARTS = 20_000  # larger components at any time, at most: a part grows with the number of nodes beyond that
TASK_NODES = 50_000  # nodes of a task, about
LINE = 1 << 16  # characters of joined ids in a row, about

NODE = ("conv_id", "depth")
KEY = ("depth", "p1", "p2")


def _before(value: Column) -> Column:
    return value.over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, span, turn, hash, chars, at) and lengths (conv_id, span, before, len): position = before + at.

    Turns are ordered by turn, null first, equal ones by a hash of role and text. Rows without conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**62))).cast("bigint").alias("span"),
        F.col("turn").cast("bigint").alias("turn"), F.unhex(said).alias("hash"), F.length(text).cast("bigint").alias("chars"),
    )
    rows = written(rows, "turns")
    place = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "hash")) - 1
    cells = rows.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    cells = cells.withColumn("before", F.coalesce(_before(F.sum("n")), F.lit(0)))
    return rows.withColumn("at", place), cells


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, hash, chars) of the rebuilt conversations, and (conv_id, len) with their lengths.

    A conversation c gets the first h turns of conversation c - c % 100 (all if fewer, none if absent) and then its own
    from h on; h is the crc32 of the id in decimals, modulo 6.
    """
    rows, cells = numbered_turns(conversations)
    lengths = cells.groupBy("conv_id").agg(F.sum("n").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("bigint")
    base = F.col("conv_id") - F.col("conv_id") % 100
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = (
        lengths.withColumns({"h": h, "base": base}).join(of_base, "base", "left")
        .withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("len", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    convs = written(convs.select("conv_id", "base", "h", "given", "len"), "conversations")
    cells = cells.select("conv_id", "span", "before").join(convs.select("conv_id", "h", "given"), "conv_id")
    turns = written(rows.join(cells, ["conv_id", "span"]).withColumn("position", F.col("before") + F.col("at")), "numbered")
    own = turns.filter("position >= h").select("conv_id", (F.col("position") - F.col("h") + F.col("given") + 1).alias("depth"), "hash", "chars")
    first = turns.filter("position < 5 AND conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "position", "hash", "chars")
    inherited = convs.filter("given > 0").select("conv_id", "base", "given").join(first, "base").filter("position < given")
    return own.unionByName(inherited.select("conv_id", (F.col("position") + 1).alias("depth"), "hash", "chars")), convs.select("conv_id", "len")


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, u1, u2, chars, len): every prefix of every conversation; u1 and u2 name the one above."""
    one, two = F.xxhash64("hash", "depth"), F.xxhash64("depth", "hash", F.lit("two"))
    rows = turns.withColumns({"span": F.floor(F.col("depth") / SPAN), "g1": one, "g2": two}).drop("hash")
    cell = Window.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("conv_id", "span").agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2"))
    carry = {f"c{i}": F.coalesce(_before(F.bit_xor(f"t{i}")), F.lit(0).cast("bigint")) for i in (1, 2)}
    cells = totals.withColumns(carry).drop("t1", "t2").join(lengths, "conv_id")
    local = rows.withColumns({f"l{i}": F.bit_xor(f"g{i}").over(cell) for i in (1, 2)})
    found = local.join(cells, ["conv_id", "span"]).withColumns({f"p{i}": F.col(f"l{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)})
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = lengths.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), none.alias("u1"), none.alias("u2"), zero.alias("chars"), "len")
    above = {f"u{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"g{i}")) for i in (1, 2)}
    return found.withColumns(above).select(*root.columns).unionByName(root)


def joined_ids(ends: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, ends_sha256): hash of the ids per key, ascending and joined by commas.

    Sorted ids become lines of bounded length, however many share a key, and the hash reads line by line.
    """
    schema = ends.select(*keys).schema

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        done: list[tuple] = []

        def line() -> None:
            done.append((*key, held[0], ",".join(map(str, held))))

        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (now != key or size > LINE):
                    line()
                    held, size = [], 0
                key = now
                held.append(conv)
                size += 20
            if len(done) > 1000:
                yield _batch(done)
                done.clear()
        if held:
            line()
        if done:
            yield _batch(done)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * (len(keys) + 1) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*keys, "first", "line"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        done: list[tuple] = []
        for batch in batches:
            for *now, _, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256()
                    sha.update(line.encode())
                else:
                    sha.update(b"," + line.encode())
            if len(done) > 10_000:
                yield _hashes(done)
                done.clear()
        if key is not None:
            done.append((*key, sha.hexdigest()))
        if done:
            yield _hashes(done)

    def _hashes(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * len(keys) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*keys, "ends_sha256"])

    named = ", ".join(f"{f.name} bigint" for f in schema)
    order = [*keys, "conv_id"]
    rows = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lines, f"{named}, first bigint, line string")
    order = [*keys, "first"]
    return rows.repartition(*keys).sortWithinPartitions(*order).mapInArrow(digests, f"{named}, ends_sha256 string")


def _centroids(parent: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree totals of each column of ``values``. Parents come before their children; -1 marks a top."""
    n = len(parent)
    size, alive, kids = [1] * n, [True] * n, [[] for _ in range(n)]
    for v in range(n - 1, -1, -1):
        if parent[v] >= 0:
            size[parent[v]] += size[v]
            kids[parent[v]].append(v)
    total = [[0] * n for _ in values]
    tops = [v for v in range(n) if parent[v] < 0]
    while tops:
        top = tops.pop()
        path = [top]
        while True:
            heavy = next((k for k in kids[path[-1]] if alive[k] and 2 * size[k] >= size[top]), None)
            if heavy is None:
                break
            path.append(heavy)
        centroid = path[-1]
        below, todo = [0] * len(values), [centroid]
        while todo:
            v = todo.pop()
            for i, column in enumerate(values):
                below[i] += column[v]
            todo += [k for k in kids[v] if alive[k]]
        gone = size[centroid]
        for v in path:
            size[v] -= gone
            for i, b in enumerate(below):
                total[i][v] += b
        alive[centroid] = False
        tops += [k for k in kids[centroid] if alive[k]]
        if centroid != top:
            tops.append(top)
    return total


def _settled(state: DataFrame, values: list[str], parts: int) -> DataFrame:
    """(conv_id, depth, values) of components that lie whole in one partition each."""
    schema = ", ".join(f"{c} bigint" for c in (*NODE, *values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        conv, depth, up, top = (table.column(c).to_pylist() for c in ("conv_id", "depth", "parent_conv_id", "top_depth"))
        place = {node: i for i, node in enumerate(zip(conv, depth, strict=True))}
        parent = [-1 if d == t else place[u, d - 1] for d, u, t in zip(depth, up, top, strict=True)]
        found = _centroids(parent, [table.column(c).to_pylist() for c in values])
        columns = [table.column(c).combine_chunks() for c in NODE] + [pa.array(f, pa.int64()) for f in found]
        yield pa.RecordBatch.from_arrays(columns, names=[*NODE, *values])

    dealt = state.select(*NODE, "parent_conv_id", "top_conv", "top_depth", *values).repartition(parts, "top_conv", "top_depth")
    return dealt.sortWithinPartitions("depth").mapInArrow(run, schema)


def rollup(nodes: DataFrame, path: DataFrame, values: list[str], least_part: int = LEAST_PART) -> DataFrame:
    """(conv_id, depth, values): the values summed over the subtree of each node, its top included.

    ``nodes`` is a written table (conv_id, depth, parent_conv_id, weight, values): a node is named by its smallest member
    and depth, weight is the number of prefixes in its subtree. ``path`` (conv_id, depth, node_conv) names the node of
    each prefix of each smallest member. Every round halves the prefixes of the components that are too large for a task.
    """
    total = nodes.count()
    part = max(least_part, -(-total // MOST_PARTS))
    root = nodes.agg(F.min("conv_id")).first()[0]
    state = nodes.withColumns({"top_conv": F.lit(root).cast("bigint"), "top_depth": F.lit(0).cast("bigint")})
    comp = ["top_conv", "top_depth"]
    added: list[DataFrame] = []
    while True:
        large = F.broadcast(state.groupBy(*comp).count().filter(F.col("count") > part).select(*comp))  # MOST_PARTS rows at most
        if large.isEmpty():
            break
        work = state.join(large, comp)
        whole = work.groupBy(*comp).agg(F.max("weight").alias("whole"))
        heavy = work.join(F.broadcast(whole), comp).filter("2 * weight >= whole")
        centre = heavy.groupBy(*comp).agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c"))
        centre = written(centre.select(*comp, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids")

        # Which stretches of members run through the centroid, and through which child of it.
        span = F.floor(F.col("depth") / SPAN)
        stretches = work.withColumn("span", span).select(*comp, "conv_id", "span").distinct().join(F.broadcast(centre), comp)
        at = path.select(F.col("conv_id"), F.col("depth").alias("at"), F.col("node_conv"))
        through = (
            stretches.withColumn("at", F.explode(F.array("c_depth", F.col("c_depth") + 1))).join(at, ["conv_id", "at"])
            .groupBy(*comp, "conv_id", "span")
            .agg(F.max(F.when((F.col("at") == F.col("c_depth")) & (F.col("node_conv") == F.col("c_conv")), 1)).alias("here"), F.max(F.when(F.col("at") > F.col("c_depth"), F.col("node_conv"))).alias("child"))
            .filter("here = 1").select(*comp, "conv_id", "span", "child")
        )
        # The way from the centroid to the top.
        climb = path.withColumnRenamed("conv_id", "c_conv").join(F.broadcast(centre), "c_conv").filter("depth BETWEEN top_depth AND c_depth")
        climb = climb.select(*comp, F.col("node_conv").alias("conv_id"), "depth", F.lit(True).alias("climbs"))
        marked = (
            work.withColumn("span", span).join(F.broadcast(centre), comp).join(through, [*comp, "conv_id", "span"], "left")
            .withColumn("below", F.col("child").isNotNull() & (F.col("depth") > F.col("c_depth")))
            .join(climb, [*comp, "conv_id", "depth"], "left")
            .withColumn("is_centre", (F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_conv")))
        )
        marked = written(marked, "marked")
        sums = marked.filter("below OR is_centre").groupBy(*comp).agg(*[F.sum(v).alias(f"s_{v}") for v in values])
        added.append(written(marked.filter("climbs").join(F.broadcast(sums), comp).select(*NODE, *[F.col(f"s_{v}").alias(v) for v in values]), "added"))
        moved = {
            "weight": F.when(F.col("climbs"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")),
            "top_conv": F.when(F.col("below"), F.col("child")).otherwise(F.col("top_conv")),
            "top_depth": F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")),
        }
        rest = marked.filter("NOT is_centre").select(*[moved.get(c, F.col(c)).alias(c) for c in state.columns])
        state = written(state.join(large, comp, "left_anti").unionByName(rest), "components")
    found = _settled(state, values, max(1, -(-total // TASK_NODES)))
    for more in added:
        found = found.unionByName(more)
    return found.groupBy(*NODE).agg(*[F.sum(v).alias(v) for v in values]) if added else found


def prefix_trie(conversations: DataFrame, least_part: int = LEAST_PART) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, a null turn comes first, equal turns are ordered by a hash of what was said, repeated
    rows are turns of their own. Rows without conv_id are left out; a conversation whose rebuilt form has no turn is a
    member of the root. An empty table gives an empty result; other columns are ignored.
    """
    turns, lengths = rebuilt_turns(conversations)
    every = written(prefixes(turns, lengths), "prefixes")
    nodes = every.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("u1").alias("u1"), F.first("u2").alias("u2"),
        F.first("chars").alias("chars"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"),
    )
    nodes = written(nodes, "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("u1").alias("p1"), F.col("u2").alias("p2")]
    children = nodes.filter("depth > 0").select(*above).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "parents")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    full = met(nodes, parents, ["depth", "u1", "u2"], "n_children").withColumns(
        {"leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("chars")}
    )
    full = written(full, "forest")
    owners = full.select("conv_id").distinct()
    path = met(every.join(owners, "conv_id", "left_semi"), nodes.select(*KEY, F.col("conv_id").alias("node_conv"), "n_convs"), list(KEY), "n_convs")
    path = written(path.select("conv_id", "depth", "node_conv"), "paths")
    sums = rollup(full.select(*NODE, "parent_conv_id", "weight", "leaf", "saved"), path, ["leaf", "saved"], least_part)

    hashes = joined_ids(every.filter("depth = len").select(*KEY, "conv_id"))
    found = full.drop("leaf", "saved").join(sums, list(NODE)).join(hashes, list(KEY), "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
