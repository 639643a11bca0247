"""Scans without keys, rows of hot keys, ordered fragments and versions."""

import random

import pytest
from pyspark.sql import functions as F

from convolake.operators import fragments as Fr
from convolake.operators import merge as M
from convolake.operators import scan
from convolake.plans import ENTRIES


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(1000), i, float(rng.randint(-5, 5)), None if i % 7 == 0 else f"v{i}") for i in range(500)]
    return rows, spark.createDataFrame(rows, "t bigint, id bigint, x double, v string").repartition(6)


@pytest.mark.parametrize("desc", [False, True])
def test_running_without_keys(numbers, desc):
    rows, df = numbers
    folds = {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))}
    got = {r.id: (r.s, r.lo, r.hi) for r in scan.with_running(df, [], ["t", "id"], F.floor(F.col("t") / 10), folds, desc).collect()}
    s, lo, hi, want = 0.0, 9.0, -9.0, {}
    for _, ident, x, _ in sorted(rows, reverse=desc):
        s, lo, hi = s + x, min(lo, x), max(hi, x)
        want[ident] = (s, lo, hi)
    assert got == want


@pytest.mark.parametrize("desc", [False, True])
def test_previous_without_keys(numbers, desc):
    rows, df = numbers
    got = {r.id: r.p for r in scan.with_previous(df, [], ["t", "id"], F.floor(F.col("t") / 10), {"p": "v"}, desc).collect()}
    ordered = sorted(rows, reverse=desc)
    assert got == {b[1]: None if a is None else a[3] for a, b in zip([None, *ordered], ordered)}


def test_clamped_without_keys(numbers):
    rows, df = numbers
    got = {r.id: (r.raw, r.low) for r in scan.with_clamped(df, [], ["t", "id"], F.floor(F.col("t") / 10), F.col("x"), 3.0).collect()}
    raw, low = 3.0, None
    for _, ident, x, _ in sorted(rows):
        raw += x
        low = raw if low is None else min(low, raw)
        assert got[ident] == (raw, low)


def test_pages_have_no_window_over_all_rows(spark):
    """The only window without keys runs over one row per range."""
    plan = ENTRIES["k13_repaginate"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lone = [x for x in plan.splitlines() if "Window [" in x and x.rstrip().endswith("[_part ASC NULLS FIRST]")]
    assert not lone or all("_p_" in x for x in lone)
    assert "Window [row_number" not in plan or "_bucket" in plan


@pytest.mark.parametrize("name", ["w5_context_window", "w14_token_backfill", "m6_delete_since", "t35_edit_token_delta", "st9_memory_admission"])
def test_messages_meet_their_key_row_by_bucket(spark, name):
    """Joins that carry texts or messages have the bucket among their keys; joins on the key alone carry cells."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ENTRIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [x for x in plan.splitlines() if "SortMergeJoin" in x or "ShuffledHashJoin" in x]
    top = joins[0]  # the join next to the result carries the rows
    assert "_bucket" in top


@pytest.mark.parametrize("how", ["inner", "left"])
def test_key_row(spark, how):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (None, 2), (4, 1)) for i in range(n)], "k int, i int")
    row = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "k int, v string")
    got = sorted(map(tuple, scan.with_key_row(df, row, ["k"], F.floor(F.col("i") / 10), how).collect()), key=repr)
    assert got == sorted(map(tuple, df.join(row, "k", how).select("k", "i", "v").collect()), key=repr)


def test_fragments(spark):
    rows = [("a", i, f"{i:03d}") for i in range(200)] + [("b", 5, "x"), ("c", 1, ""), ("c", 2, "y")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, v string")
    parts = Fr.fragments(df, ["k"], ["t"], F.floor(F.col("t") / 16), F.col("v"), ("t",))
    assert {(r.k, r.position): r.fragment for r in parts.collect()} == {**{("a", i): f"{i:03d}" for i in range(200)}, ("b", 0): "x", ("c", 0): "", ("c", 1): "y"}
    got = {r.k: (r.n, r.chars, r.value) for r in Fr.whole(parts, ["k"], "-", most=100).collect()}
    assert got == {"a": (200, 799, None), "b": (1, 1, "x"), "c": (2, 2, "-y")}
    assert {r.k: r.value for r in Fr.whole(parts, ["k"], "-").collect()}["a"] == "-".join(f"{i:03d}" for i in range(200))
    ordered = [(r.k, r.position) for r in Fr.in_order(parts, ["k"]).collect()]
    assert ordered == sorted(ordered)


def test_reverted(spark):
    versions = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "x"), (1, 3, "a", "x"), (2, 1, "q", None)], "k int, version bigint, f string, g string")
    wanted = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1)], "k int, wanted int")
    got = sorted(map(tuple, M.reverted(versions, wanted, ["k"], ["f", "g"]).collect()), key=repr)
    assert got == [(1, 1, "a", "x", "unchanged", 3), (2, 1, "q", None, "unchanged", 1), (2, 2, None, None, "missing", 1), (3, 1, None, None, "missing", None)]
    got = M.reverted(versions, spark.createDataFrame([(1, 2)], "k int, wanted int"), ["k"], ["f", "g"]).collect()
    assert [tuple(r) for r in got] == [(1, 2, "b", "x", "appended", 4)]


def test_questions_pass_by_resting_documents(spark):
    """20 000 questions: the documents are dealt once, and every question finds what a plain search finds."""
    import numpy as np

    from convolake.operators import retrieve

    rng = np.random.default_rng(5)
    q, d = rng.integers(-3, 4, (20_000, 4)).astype(float), rng.integers(-3, 4, (300, 4)).astype(float)
    frame = lambda m, key: spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], f"{key} bigint, vector array<double>")
    found = retrieve.nearest_by_blocks(frame(q, "q_id"), frame(d, "doc_id"), 2, document_block=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    near = retrieve.nearest(frame(q, "q_id"), frame(d, "doc_id"), 2)
    got = {}
    for r in near.collect():
        got.setdefault(r.q_id, {})[r["rank"]] = (r.doc_id, r.score)
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    scores = np.round(unit(q) @ unit(d).T, 9) + 0.0
    assert len(got) == 20_000
    for i in range(0, 20_000, 371):
        best = np.lexsort((np.arange(300), -scores[i]))[:2]
        assert [got[i][n][0] for n in (1, 2)] == best.tolist()


def test_joined_values_are_whole_and_long_keys_are_not_gathered(spark):
    rows = [(k, i, f"v{i}") for k in (1, 2, None) for i in range(30 if k != 2 else 200)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, v string").repartition(5)
    got = {r.k: (r.n, r.chars, r.value) for r in Fr.joined(df, ["k"], ["i"], F.col("v"), ",", most=300).collect()}
    short = ",".join(f"v{i}" for i in range(30))
    assert got[1] == got[None] == (30, len(short), short)
    assert got[2] == (200, len(",".join(f"v{i}" for i in range(200))), None)


def test_attachments_move_rows_once(spark):
    """One exchange of rows; it was a chain of seven that numbered, joined back and gathered."""
    plan = ENTRIES["a22_attachments_by_call"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_reach_is_each_pair_once_without_a_shuffle_of_pairs(spark):
    from convolake.operators import acl as A

    rng = random.Random(3)
    pri = [(u, "user", str(u)) for u in range(40)] + [(u, "public", None) for u in range(40)]
    pri += [(u, "role", f"r{u % 3}") for u in range(40) if u % 4]
    pri += [(u, "group", str(g)) for u in range(40) for g in rng.sample(range(5), u % 3)]
    acl = []
    for _ in range(300):
        kind = rng.choice(["user", "role", "group", "public"])
        who = {"user": str(rng.randrange(45)), "role": f"r{rng.randrange(4)}", "group": str(rng.randrange(6)), "public": None}[kind]
        acl.append((rng.randrange(25), kind, who, 1 << rng.randrange(4)))
    principals = spark.createDataFrame(pri, "user_id bigint, principal_type string, principal_id string")
    grants = spark.createDataFrame(acl, "resource_id bigint, principal_type string, principal_id string, perm_bits int")
    want, public = {}, {}
    for r, kind, who, bits in acl:
        if kind == "public":
            public[r] = public.get(r, 0) | bits
        for u, k, p in pri:
            if k == kind != "public" and p == who:
                want[u, r] = want.get((u, r), 0) | bits
    want = {(u, r): b | public.get(r, 0) for (u, r), b in want.items()} | {(None, r): b for r, b in public.items()}
    frame = A.effective(principals, grants)
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(repr((u, r, b)) for (u, r), b in want.items())
    for name in ("a5_effective_permissions", "j10_accessible"):
        plan = ENTRIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(user_id" not in plan


def test_gap_fill_gives_one_whole_message_per_conversation(spark):
    folder = "/root/testdata/sf0.001"
    got = ENTRIES["w16_gap_fill"].run(spark, folder).collect()
    steps = {}
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").collect():
        steps.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity))
    want = {}
    for o in spark.read.parquet(f"{folder}/orders.parquet").collect():
        if o.o_orderstatus == "O" and o.o_orderkey in steps:
            want[o.o_orderkey] = (",".join(str(x[1]) for x in sorted(steps[o.o_orderkey])), True)
        elif o.o_orderstatus != "F":
            want[o.o_orderkey] = ("stored", False)
    assert len(got) == len(want) and {r["conv"]: (r["content"], r["synced"]) for r in got} == want


def test_gap_fill_numbers_the_steps_of_a_message(spark, tmp_path):
    orders = [(1, "O"), (2, "P"), (3, "F"), (4, "O")]
    steps = [(1, 2, 70, 1, 5.0), (1, 1, 90, 2, 1.0), (1, 2, 30, 9, 5.0), (2, 1, 11, 1, 1.0), (3, 1, 12, 1, 1.0)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    shape = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double"
    spark.createDataFrame(steps, shape).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["conv"]: (r["parts"], r["content"], r["fragments"], r["synced"]) for r in ENTRIES["w16_gap_fill"].run(spark, str(tmp_path)).collect()}
    stored = (1, "stored", "0:stored", False)
    assert got == {1: (3, "90,30,70", "0:90,1:30,2:70", True), 2: stored, 4: stored}


def test_keyword_join_shuffles_no_pairs_of_documents_and_questions(spark, monkeypatch):
    from convolake.operators import retrieve

    docs = spark.createDataFrame([(i, ["alpha beta, gamma", "xalphax beta", None, "", "delta"][i % 5]) for i in range(50)], "doc_id bigint, text string")
    words = spark.createDataFrame([(q, w, t) for q in range(40) for w, t in (("alpha", 2), ("beta", 1))], "q_id bigint, keyword string, times bigint")
    hits = retrieve.keyword_hits_by_join(words, docs)
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, hits.collect())) == sorted((q, i, 3, False) for q in range(40) for i in range(50) if i % 5 < 2)
    monkeypatch.setattr(retrieve, "BROADCAST_KEYWORDS", 1)  # too many keywords to send: by shuffled joins, the same rows
    joined = retrieve.keyword_hits_by_join(words, docs)
    assert "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
    assert hits.exceptAll(joined).count() == 0 and joined.count() == hits.count()


@pytest.mark.parametrize("name", ["t5_chunks", "w4_chunk_index"])
def test_chunks_are_made_once(spark, name):
    from conftest import DATA

    plan = ENTRIES[name].run(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_parts_of_file_access_grow_with_the_ways(spark, monkeypatch):
    """A task's groups stay few; repeated attachments and several ways give one row with the strongest reason."""
    from convolake.operators import acl

    monkeypatch.setattr(acl, "TASK_WAYS", 10, raising=False)
    files = spark.createDataFrame([(f, f % 3) for f in range(50)], "file_id bigint, owner bigint")
    attached = spark.createDataFrame([(a, f) for f in range(50) for a in (f % 4, f % 4, 7)], "agent_id bigint, file_id bigint")
    agents = spark.createDataFrame([(a, a % 2) for a in range(8)], "agent_id bigint, author bigint")
    edits = spark.createDataFrame([(7, 1), (7, 90), (2, 91)], "agent_id bigint, user_id bigint")
    found = acl.file_access(files, attached, agents, edits)
    want = {}
    for f in range(50):
        ways = [(f % 3, "owner"), *[(a % 2, "author") for a in (f % 4, 7)], (1, "editor"), (90, "editor"), *([(91, "editor")] if f % 4 == 2 else [])]
        for user, reason in ways:
            want.setdefault((f, user), reason)
    assert {(r.file_id, r.user_id): r.reason for r in found.collect()} == want and found.count() == len(want)
    assert found.rdd.getNumPartitions() == 15
