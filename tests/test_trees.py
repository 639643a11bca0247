"""Trees and context windows against known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from convolake.operators import context as C
from convolake.operators import trees as T

ROOT = T.ROOT
T1 = [(7, ROOT), (8, ROOT), (5, 7), (6, 7), (9, 8), (2, 5), (3, 5), (1, 6), (4, 6), (10, 3)]
T2 = [(11, ROOT), (12, ROOT), (13, 11), (14, 12), (15, 13), (16, 13), (21, 13), (17, 14), (18, 16), (19, 18), (20, 19)]
CYCLE = [(1, 2), (2, 3), (3, 1)]
NOW = dt.datetime(2024, 1, 1)


def forest(spark, pairs, summaries=None):
    rows = [
        (1, m, p, "user", f"text {m}", NOW + dt.timedelta(minutes=i), 1, (summaries or {}).get(m))
        for i, (m, p) in enumerate(pairs)
    ]
    shape = "conv_id bigint, msg bigint, parent bigint, role string, text string, created_at timestamp_ntz, tokens bigint, summary string"
    return spark.createDataFrame(rows, shape)


def target(spark, msg):
    return spark.createDataFrame([(1, msg)], "conv_id bigint, target bigint")


def ids(df):
    return sorted(r["msg"] for r in df.collect())


@pytest.mark.parametrize(
    "msg, want",
    [(5, [5, 6, 7, 8, 9]), (10, list(range(1, 11))), (7, [7, 8]), (123, [])],
)
def test_up_to_target_level(spark, msg, want):
    assert ids(T.up_to_target_level(forest(spark, T1), target(spark, msg))) == want


@pytest.mark.parametrize(
    "msg, want, roots",
    [(2, [1, 2, 3, 4, 10], [1, 2, 3, 4]), (5, [1, 2, 3, 4, 5, 6, 9, 10], [5, 6, 9]), (10, [10], [10])],
)
def test_split_at_target_level(spark, msg, want, roots):
    split = T.split_at_target_level(forest(spark, T1), target(spark, msg))
    assert ids(split) == want
    assert ids(split.filter(F.col("parent") == ROOT)) == roots


@pytest.mark.parametrize("msg, want", [(18, [11, 13, 15, 16, 18, 21]), (11, [11])])
def test_path_with_siblings(spark, msg, want):
    found = ids(T.path_with_siblings(forest(spark, T2), target(spark, msg)))
    assert found == want


def test_cycle_is_walked_once(spark):
    assert ids(T.path_with_siblings(forest(spark, CYCLE), target(spark, 1))) == [1, 2, 3]
    assert ids(T.path_to_root(forest(spark, CYCLE), target(spark, 1))) == [1, 2, 3]


def test_path_order_and_summary(spark):
    rows = T.path_to_root(forest(spark, T2), target(spark, 20)).orderBy("position").collect()
    assert [r["msg"] for r in rows] == [11, 13, 16, 18, 19, 20]
    cut = T.path_to_root(forest(spark, T2, {13: "old", 18: "so far"}), target(spark, 20), summary="summary")
    rows = cut.orderBy("position").collect()
    assert [(r["msg"], r["role"], r["text"]) for r in rows[:1]] == [(18, "system", "so far")]
    assert [r["msg"] for r in rows] == [18, 19, 20]


def test_nested_selections(spark):
    """Path ⊆ path with siblings ⊆ everything down to the level."""
    f, t = forest(spark, T2), target(spark, 18)
    path, wide, level = (set(ids(op(f, t))) for op in (T.path_to_root, T.path_with_siblings, T.up_to_target_level))
    assert path <= wide <= level


def test_deep_chain(spark):
    n = 300
    chain = forest(spark, [(i, i - 1 if i else ROOT) for i in range(n)])
    assert {r["msg"]: r["depth"] for r in T.depths(chain).collect()} == {i: i for i in range(n)}
    assert {r["msg"]: r["size"] for r in T.subtree_sizes(chain).collect()} == {i: n - i for i in range(n)}


def test_orphan_is_a_root_for_depth_but_not_for_levels(spark):
    f = forest(spark, [(1, ROOT), (2, 1), (3, 99), (4, 3)])
    assert {r["msg"]: r["depth"] for r in T.depths(f).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert ids(T.up_to_target_level(f, target(spark, 2))) == [1, 2]


def test_linearise(spark):
    rows = T.linearised(forest(spark, T1)).orderBy("position").collect()
    assert [r["msg"] for r in rows] == [7, 5, 2, 3, 10, 6, 1, 4, 8, 9]
    assert [r["msg"] for r in rows if r["on_last_branch"]] == [8, 9]


def test_times_follow_parents(spark):
    f = forest(spark, T1).withColumn("created_at", F.lit(NOW).cast("timestamp_ntz"))
    got = {r["msg"]: r["fixed_ms"] for r in T.later_than_parent(f).collect()}
    assert got[7] == got[8] and got[5] == got[7] + 1 and got[3] == got[7] + 2 and got[10] == got[7] + 3


def test_clone_keeps_shape(spark):
    rows = T.cloned(forest(spark, T1), "x").collect()
    new = {r["source_msg"]: r["new_id"] for r in rows}
    assert len(set(new.values())) == len(T1)
    assert {r["source_msg"]: r["new_parent"] for r in rows} == {m: new.get(p) for m, p in T1}


def test_fork_with_split(spark):
    rows = T.fork(forest(spark, T1), target(spark, 5), "direct_path", "f", split_latest=target(spark, 10)).collect()
    assert sorted(r["source_msg"] for r in rows) == [3, 5, 10]
    assert [r["source_msg"] for r in rows if r["new_parent"] is None] == [5]


def window(spark, counts):
    rows = [(1, i, t) for i, t in enumerate(counts)]
    return spark.createDataFrame(rows, "conv_id bigint, msg bigint, tokens bigint")


@pytest.mark.parametrize(
    "limit, counts, kept, remaining",
    [(100, [5, 19, 18], [0, 1, 2], 55), (50, [30, 30, 5, 19, 18], [2, 3, 4], 5)],
)
def test_context_window(spark, limit, counts, kept, remaining):
    rows = C.within_limit(window(spark, counts), limit).orderBy("msg").collect()
    assert [r["msg"] for r in rows if r["in_context"]] == kept
    assert {r["remaining"] for r in rows} == {remaining}


def test_context_window_across_buckets(spark):
    """The result does not depend on where a conversation is cut."""
    counts = [(i * 7) % 11 + 1 for i in range(200)]
    df = window(spark, counts)
    whole = {r["msg"]: r["suffix"] for r in C.suffix_tokens(df, F.lit(0)).collect()}
    cut = {r["msg"]: r["suffix"] for r in C.suffix_tokens(df, F.floor(F.col("msg") / 16)).collect()}
    assert whole == cut == {i: sum(counts[i:]) for i in range(200)}
