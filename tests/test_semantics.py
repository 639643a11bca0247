"""Operators against hand-made results and plain sequential versions."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from convolake.functions import content as C
from convolake.functions import text as X
from convolake.functions.chunks import chunks, cut_text
from convolake.functions.vectors import with_hashed_vector
from convolake.operators import acl, billing, citations, merge, paging, retrieve, scan, sets
from convolake.operators.dedup import _apart, _candidates, _similar, keep_first_similar, prefix_index, signatures, word_sets
from convolake.sources import files, imports
from convolake.streaming import limits, stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- text ---------------------------------------------------------------------------------------------------------


def test_clean_text(spark):
    assert one(spark, X.clean_text(F.lit(" a\r\nb\r\n\r\n\r\nc\td  e "))) == "a\nb c d e"


def test_sentences_keep_abbreviation(spark):
    assert one(spark, X.sentences(F.lit("T.C vatandaşı. Evet! Son"))) == ["T.C vatandaşı", "Evet", "Son"]


def test_token_estimate(spark):
    assert one(spark, X.token_estimate(F.lit(""))) == 2
    assert one(spark, X.token_estimate(F.lit("a b c"))) == 4


def test_keywords_strip_after_the_tests(spark):
    assert one(spark, X.keywords(F.lit("Nasıl ne? ??? izin İZİN'i"))) [:3] == ["ne", "", "izin"]


def test_text_hash(spark):
    def plain(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h)

    for word in ("", "abc", "çalışan", "averyveryverylongwordindeed"):
        assert one(spark, X.text_hash(F.lit(word))) == plain(word)


def test_hashed_vector_counts_first_200_terms(spark):
    words = [f"w{i:03d}x" for i in range(250)] + ["900", "100"]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "")], "id bigint, text string")
    vectors = {r["id"]: r["vector"] for r in with_hashed_vector(df, "id", "text").collect()}
    assert sum(v > 0 for v in vectors[1]) <= 200 and math.isclose(sum(v * v for v in vectors[1]), 1.0)
    assert set(vectors[2]) == {0.0}


def test_redaction(spark):
    assert one(spark, X.redact(F.lit("sk-abc x Bearer t1 Bearer t2 url?key=z"))) == (
        "sk-[REDACTED] x Bearer [REDACTED] Bearer t2 url?key=[REDACTED]"
    )


def pack(text, size, overlap):
    """Sequential form of the chunker."""
    est = lambda s: math.ceil(len(s.split(" ")) * 1.3)
    parts = [p.strip() for p in __import__("re").split(r"[.!?\n]+", text)]
    out, cur, tokens = [], "", 0
    for s in [p for p in parts if p]:
        n = est(s)
        if n > size:
            out += [cur] if cur else []
            words = s.split(" ")
            step = size // 2
            out += [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
            cur, tokens = "", 0
        elif tokens + n > size:
            out.append(cur)
            words = cur.split(" ")
            k = 0
            while k < len(words) and math.ceil(k * 1.3) < overlap:
                k += 1
            tail = cur if est(cur) <= overlap else " ".join(words[-k:])
            cur = tail + " " + s
            tokens = est(cur)
        else:
            cur = f"{cur} {s}" if cur else s
            tokens += n
    return [c.strip() for c in out + ([cur] if cur else []) if c.strip()]


def test_chunks_equal_the_sequential_form(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        sentences = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 8, 20, 60]))) for _ in range(rng.randrange(1, 25))]
        texts.append(". ".join(sentences) + rng.choice(["", "."]))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", chunks(F.col("t"), 40, 10).alias("c")).collect():
        assert row["c"] == pack(row["t"], 40, 10)


def test_chunks_of_the_documents_keep_every_word(tables):
    rows = tables.documents.select("text", X.sentences(F.col("text")).alias("s"), chunks(F.col("text")).alias("c")).collect()
    for r in rows:
        assert r["c"] == pack(r["text"].replace("T.C", "T_TEMP_C"), 750, 100) or "T.C" in r["text"]
        assert {w for s in r["s"] for w in s.split()} == {w for c in r["c"] for w in c.split()}


def test_cut_text():
    text = "One. Two and three! " + "x" * 50 + " tail"
    pieces = cut_text(text, 25)
    assert pieces[0] == "One. Two and three!"
    assert "".join(pieces).replace(" ", "") == text.replace(" ", "")


# --- content parts and citations -----------------------------------------------------------------------------------


def test_splice_and_offsets(spark):
    edits = F.array(
        F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("<a>").alias("text")),
        F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("<b>").alias("text")),
    )
    assert one(spark, C.splice(F.lit("0123456"), edits)) == "<a>1<b>456"
    found = one(spark, C.matches_with_offsets(F.lit("ab12cd345"), r"\d+"))
    assert [(m["start"], m["end"], m["match"]) for m in found] == [(2, 4, "12"), (6, 9, "345")]


def test_citation_numbers(spark):
    esc = "\\u"
    m = lambda i: f"{esc}e202turn0search{i}"
    text = f"{esc}e203big{esc}e204 x{m(2)} y{m(0)} z{esc}e200{m(0)}{m(1)}{esc}e201 q {m(9)}"
    texts = spark.createDataFrame([(1, text), (2, "plain")], "id bigint, text string")
    sources = spark.createDataFrame(
        [(1, 0, "search", 0, "a"), (1, 0, "search", 1, "b"), (1, 0, "search", 2, "b")],
        "id bigint, turn int, kind string, idx int, link string",
    )
    got = {r["id"]: r for r in citations.number_citations(texts, sources, "id").collect()}
    assert got[1]["text"] == "**big** x[1] y[2] z[1][2] q"
    assert got[1]["citations"] == "[1] b\n[2] a"
    assert got[2]["text"] == "plain" and got[2]["citations"] == ""


def test_annotations(spark):
    note = "struct<type:string,start:int,end:int,file:string>"
    df = spark.createDataFrame(
        [(1, "see [1][2] and [p]", [("file_citation", 4, 7, "f"), ("file_citation", 7, 10, "f"), ("file_path", 15, 18, "/x")])],
        f"id bigint, text string, notes array<{note}>",
    )
    assert citations.apply_annotations(df, "id").first()["text"] == "see ^1^ and /x\n\n^1.^ f"


def test_annotations_of_short_and_odd_texts_as_in_sql(spark, tmp_path):
    import duckdb
    from oracle import compare

    from convolake.plans import ENTRIES

    texts = [None, "", "a", "ab", "abc", " ", "   ", "a\ue000b\ue001cdefgh", "\ue0002\ue001" * 6, "^1^ ^2^ ^1^ xx", "a b\n" * 9]
    names = [("src", "en"), ("en", "en"), (None, "en"), ("src", None), ("$1\\2", "e$1")]
    rows = [(i * 10 + j, text, *name) for i, text in enumerate(texts) for j, name in enumerate(names)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    query = ENTRIES["t39_annotations"]
    assert compare(query.run(spark, str(tmp_path)), con, query.sql) is None


def test_artifact_without_end(spark):
    found = one(spark, citations.artifacts(F.lit("a :::artifact one\n::: b :::artifact open")))
    assert [(a["start"], a["end"]) for a in found] == [(2, 21), (24, 40)]
    assert one(spark, citations.replace_in_artifact(F.lit("x"), 0, F.lit("a"), F.lit("b"))) is None


def test_citation_splice_on_nested_brackets(spark):
    text = "[" * 2000 + "x"
    c = F.array(F.struct(F.lit("webpage").alias("type"), F.lit(0).alias("start_ix"), F.lit(2000).alias("end_ix"), F.lit("t").alias("title"), F.lit("u").alias("url")))
    assert one(spark, imports.cite(F.lit(text), c)) == " ([t](u))x"


def test_split_rows(spark):
    shape = "array<struct<type:string,text:string,think:string,name:string,args:string,output:string,announces:boolean>>"
    parts = [
        ("text", "intro", None, None, None, None, False),
        ("text", "calling", None, None, None, None, True),
        ("tool_call", None, None, "find", "{}", "found", False),
        ("think", None, "hm", None, None, None, False),
        ("text", "done", None, None, None, None, False),
    ]
    df = spark.createDataFrame([(parts,)], f"p {shape}")
    rows = df.select(C.split_rows(F.col("p")).alias("r")).first()["r"]
    assert [(r["kind"], r["name"], r["content"]) for r in rows] == [
        ("assistant", None, "intro\n\ncalling"), ("tool", "find", "found"), ("assistant", None, "done"),
    ]


# --- retrieval -----------------------------------------------------------------------------------------------------


def vectors(spark, n, dims, seed, name):
    rng = random.Random(seed)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(dims)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<double>")


def test_block_grid_equals_broadcast(spark):
    q, d = vectors(spark, 13, 6, 1, "q_id"), vectors(spark, 90, 6, 2, "doc_id")
    near = sorted(map(tuple, retrieve.nearest(q, d, 5).select("q_id", "rank", "doc_id").collect()))
    grid = retrieve.nearest_by_blocks(q, d, 5, question_block=4, document_block=20)
    top = retrieve.top_per(grid, ["q_id"], [F.desc("score"), F.asc("doc_id")], 5)
    assert near == sorted(map(tuple, top.select("q_id", "rank", "doc_id").collect()))
    assert len(near) == 13 * 5


def test_keyword_scan_equals_join(spark, tables):
    questions = tables.benchmark.select(F.col("item_id").alias("q_id"), "text")
    docs = tables.documents.select("doc_id", "text")
    words = retrieve.question_keywords(questions).filter("keyword <> ''")
    a = retrieve.keyword_hits_by_scan(words, docs)
    b = retrieve.keyword_hits_by_join(words, docs)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_citation_limits(spark):
    rows = [("file1", 1, 0.9), ("file1", 2, 0.8), ("file1", 3, 0.7), ("file2", 4, 0.85), ("file2", 5, 0.75), ("file2", 6, 0.4)]
    df = spark.createDataFrame(rows, "file_id string, source_id bigint, relevance double")
    assert [r["relevance"] for r in retrieve.limit_citations(df, per_file=2, total=3).collect()] == [0.9, 0.85, 0.8]


def test_hybrid_rank_dominates(spark):
    v = spark.createDataFrame([(1, 10, 0.1, 1), (1, 11, 0.9, 2)], "q_id bigint, doc_id bigint, score double, rank int")
    k = spark.createDataFrame([(1, 11, 3.5, 1), (1, 12, 0.5, 2)], "q_id bigint, doc_id bigint, score double, rank int")
    got = retrieve.hybrid_merge(v, k).orderBy("rank").collect()
    assert [(r["doc_id"], r["final_score"]) for r in got] == [(11, 1.75), (10, 0.67), (12, 0.25)]


# --- near duplicates -------------------------------------------------------------------------------------------------


def greedy(rows, threshold=0.7):
    import re

    words = lambda t: {w for w in re.split(r"\s+", re.sub(r"[^a-zA-Z0-9_\s]", "", t.lower())) if len(w) > 2}
    kept = []
    for g, k, t in sorted(rows):
        if len(t.strip()) < 20:
            continue
        s = words(t)
        if not any(g == g2 and s | s2 and len(s & s2) / len(s | s2) >= threshold for g2, _, s2 in kept):
            kept.append((g, k, s))
    return sorted((g, k) for g, k, _ in kept)


@pytest.mark.parametrize("front", [2, 7, 256])
def test_keep_first_similar_is_the_greedy_result(spark, front):
    rng = random.Random(front)
    rows = []
    for i in range(160):
        # a third are near copies of one text, the rest overlap at random
        base = range(20) if i % 3 == 0 else rng.sample(range(45), 14)
        words = [f"word{w}" for w in base]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"word{rng.randrange(45)}"
        rows.append(("g" + str(i % 2), i, " ".join(words)))
    rows += [("g0", 900, "x y z a b c d e f g h i j k"), ("g0", 901, "x y z a b c d e f g h i j k"), ("g0", 902, "short")]
    df = spark.createDataFrame(rows, "grp string, id bigint, text string")
    got = keep_first_similar(df, "grp", "id", "text", front=front)
    assert sorted((r["grp"], r["id"]) for r in got.collect()) == greedy(rows)


def similar_rows(seed):
    """Sets of common words, copies of some with words changed, left out or added, and the words of each."""
    rng = random.Random(seed)
    words, odds = [f"word{w}" for w in range(900)], [1 / (w + 3) for w in range(900)]
    texts = [list(dict.fromkeys(rng.choices(words, odds, k=rng.choice([1, 2, 3, 5, 8, 20, 60, 200])))) for _ in range(250)]
    for base in rng.sample(texts, 80):
        less, more = rng.choice([(0, 20), (0, 40), (0.05, 20), (0.1, 10), (0.18, 4), (0.3, 20)])
        kept = [w for w in base if rng.random() > less]
        texts.append(kept + rng.choices(words, k=rng.randrange(1 + len(base) // more)) or base)
    return [("g", i, " ".join(sorted(set(t)))) for i, t in enumerate(texts)]


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.9])
def test_index_of_similar_texts_finds_every_pair_and_few_others(spark, threshold):
    rows = list({t: (g, i, t) for g, i, t in similar_rows(int(threshold * 10))}.values())
    sets = spark.createDataFrame([(g, i, t, len(t.split())) for g, i, t in rows], "g string, k bigint, words string, n int")
    index = prefix_index(sets, threshold).filter("word IS NOT NULL").localCheckpoint()
    pairs = {(r["first"], r["k"]) for r in _candidates(index, index, threshold).collect()}
    word = {i: set(t.split()) for _, i, t in rows}
    share = lambda a, b: len(word[a] & word[b]) / len(word[a] | word[b])
    want = {(a, b) for a in word for b in word if a < b and share(a, b) >= threshold}
    assert len(want) >= 10 and want <= pairs
    bits = signatures(sets).localCheckpoint()
    frame = spark.createDataFrame([("g", b, a) for a, b in pairs], "g string, k bigint, first bigint")
    assert {(r["first"], r["k"]) for r in _similar(frame, sets, bits, threshold).collect()} == want
    if threshold == 0.7:
        near = frame.join(bits, ["g", "k"]).join(bits.select("g", F.col("k").alias("first"), F.col("n").alias("_n"), F.col("bits").alias("_bits")), ["g", "first"])
        wrong = [r for r in near.select("k", "first", _apart().alias("d")).collect() if r["d"] > len(word[r["k"]] ^ word[r["first"]])]
        assert not wrong


def test_texts_that_share_words_but_not_much_are_no_candidates(spark):
    rng = random.Random(1)
    # 60 of 3 000 words each: any word is in 12 of 600 texts
    rows = [("g", i, " ".join(f"w{x:04d}" for x in sorted(rng.sample(range(3000), 60))), 60) for i in range(600)]
    index = prefix_index(spark.createDataFrame(rows, "g string, k bigint, words string, n int"), 0.7).filter("word IS NOT NULL").localCheckpoint()
    assert _candidates(index, index, 0.7).count() < 2000


def test_keep_first_similar_without_group_or_key(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [("g", 1, text), ("g", 2, text + " iota"), ("g", None, text + " kappa"), (None, 3, text + " kappa"), (None, 4, text), ("h", 5, text + " iota")]
    got = keep_first_similar(spark.createDataFrame(rows, "grp string, id bigint, text string"), "grp", "id", "text")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("g", 1), ("g", None), ("h", 5)]))


def test_index_of_similar_texts_leaves_out_words_that_meet_nothing(spark):
    rows = [("g", i, " ".join(f"own{i}x{j}" for j in range(40))) for i in range(6)]
    rows += [("g", 10 + i, " ".join(["common", "shared", *(f"rare{i // 2}x{j}" for j in range(20)), f"last{i}"])) for i in range(4)]
    sets = word_sets(spark.createDataFrame(rows, "grp string, id bigint, text string"), "grp", "id", "text", 20)
    index = prefix_index(sets, 0.7).collect()
    assert sorted(r["k"] for r in index if r["word"] is None) == list(range(6))
    met = {}
    for r in index:
        if r["word"] is not None:
            assert isinstance(r["word"], int)
            met.setdefault(r["word"], set()).add(r["k"])
    assert {10, 11} in met.values() and {12, 13} in met.values() and all(len(ks) > 1 for ks in met.values())


def test_word_set_and_terms_on_odd_characters(spark):
    text = "Ab\u00a0cde\u3000FGH i\u0307jk, \U0001f600xyz-abc\x0bqrs\ufeff_12 \u0130stan \u015fimdi na\u00efve" + "!" * 50_000 + "end"
    shape = spark.createDataFrame([(text,)], "text string")
    words = shape.select(X.word_set(F.col("text")).alias("w"))
    kept = "".join(c for c in text.lower() if (c.isascii() and (c.isalnum() or c in "_ \t\n\x0b\f\r")) or c in "\u00a0\u3000\ufeff")
    assert words.first()["w"] == list(dict.fromkeys(w for w in kept.split() + [] for w in w.split("\ufeff") if len(w) > 2))
    assert "[^a-zA-Z0-9_" not in words._jdf.queryExecution().toString()
    terms = "".join(c if (c.isascii() and (c.isalnum() or c == "_")) or c in "çğıöşü" else " " for c in text.lower()).split()
    got = shape.select(X.vector_terms(F.col("text")).alias("t")).first()["t"]
    assert got == [w for w in terms if len(w) > 2]


def test_documents_keep_first_similar(spark, tables):
    docs = tables.documents.select("source", "doc_id", "text")
    got = keep_first_similar(docs, "source", "doc_id", "text")
    assert sorted(map(tuple, got.collect())) == greedy([tuple(r) for r in docs.collect()])


# --- running scans, ledgers ------------------------------------------------------------------------------------------


def test_running_balance_equals_the_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(5000)), i, float(rng.randrange(-40, 30))) for i in range(600)]
    df = spark.createDataFrame(rows, "user bigint, ts timestamp_ntz, id bigint, delta double")
    got = {r["id"]: r["balance"] for r in billing.running_balance(df, 25.0, F.date_trunc("hour", "ts")).collect()}
    state = {}
    for user, _, ident, delta in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        state[user] = max(0.0, state.get(user, 25.0) + delta)
        assert math.isclose(got[ident], state[user], abs_tol=1e-9)
    assert min(got.values()) >= 0


def test_number_and_previous_across_buckets(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    rows = scan.with_number(df, ["k"], ["v"], F.floor(F.col("v") / 10), "rn").collect()
    assert all(r["rn"] == r["v"] // 2 + 1 for r in rows)
    rows = scan.with_previous(df, ["k"], ["v"], F.floor(F.col("v") / 7), {"p": "v"}).collect()
    assert all(r["p"] == (r["v"] - 2 if r["v"] >= 2 else None) for r in rows)
    down = scan.with_number(df, ["k"], ["v"], F.floor(F.col("v") / 7), "rn", desc=True).collect()
    assert all(r["rn"] == 50 - r["v"] // 2 for r in down)


def test_null_keys_form_one_group(spark):
    df = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    rows = scan.with_number(df, ["k"], ["v"], F.floor(F.col("v") / 8), "rn").collect()
    assert len(rows) == 60 and all(r["rn"] == r["v"] // 3 + 1 for r in rows)
    rows = scan.with_previous(df, ["k"], ["v"], F.floor(F.col("v") / 8), {"p": "v"}).collect()
    assert all(r["p"] == (r["v"] - 3 if r["v"] >= 3 else None) for r in rows)


def test_published_billing_cases(spark):
    usage = spark.createDataFrame([(1, "gpt-3.5-turbo", 100.0, 50.0, "message")], "user int, model string, prompt_tokens double, completion_tokens double, context string")
    rates = billing.model_rates(usage)
    total = billing.usage_transactions(usage, rates).agg(F.sum("token_value")).first()[0]
    assert 10000000 + total == 9999750
    r = billing.model_rates(spark.createDataFrame([("claude-3-5-sonnet",)], "model string")).first()
    value, raw, _ = billing.structured_prompt(F.lit(11.0), F.lit(140522.0), F.lit(0.0), F.lit(r["prompt"]), F.lit(r["write"]), F.lit(r["read"]))
    assert math.isclose(17613154.55 + one(spark, value) - 5 * r["completion"], 17086089.05)
    assert one(spark, raw) == -140533


@pytest.mark.parametrize(
    "model, key",
    [
        ("gpt-3.5-turbo-16k-0613", "16k"), ("gpt-4-0125-preview", "gpt-4-1106"), ("gpt-4o-mini-2024-07-18", "gpt-4o-mini"),
        ("openai/gpt-4o", "gpt-4o"), ("gpt-4-32k-0613", "32k"), ("claude-3-5-sonnet-20241022", "claude-3-5-sonnet"),
        ("claude-3-opus-20240229", "claude-3-opus"), ("nothing-known", None),
    ],
)
def test_billing_keys(spark, model, key):
    assert one(spark, billing.billing_key(F.lit(model))) == key


def test_month_addition_runs_over(spark):
    ts = F.lit("2024-01-31 10:00:00").cast("timestamp_ntz")
    assert one(spark, billing.add_interval(ts, F.lit(1), F.lit("months"))) == dt.datetime(2024, 3, 2, 10)
    assert one(spark, billing.add_interval(ts, F.lit(1), F.lit("eons"))) == dt.datetime(2024, 1, 31, 10)


# --- paging, sets, merges --------------------------------------------------------------------------------------------


def test_pages_concatenate_to_the_whole(tables):
    orders = tables.orders.select("o_orderkey", "o_orderdate")
    whole = [tuple(r) for r in orders.orderBy(F.desc("o_orderdate"), "o_orderkey").collect()]
    got, after = [], None
    while True:
        page = paging.keyset_page(orders, "o_orderdate", "o_orderkey", 400, after).orderBy(F.desc("o_orderdate"), "o_orderkey").collect()
        got += [tuple(r) for r in page[:400]]
        if len(page) <= 400:
            break
        after = (page[399]["o_orderdate"], page[399]["o_orderkey"])
    assert got == whole


def test_cursor_round_trip():
    values = {"updatedAt": "2024-01-01", "id": 7}
    assert paging.decode_cursor(paging.encode_cursor(values)) == values
    assert [paging.clamp_limit(v) for v in (None, "x", 0, 500, 7, -3)] == [20, 20, 20, 100, 7, 1]


def test_date_buckets(spark):
    now = dt.datetime(2024, 6, 20, 12)
    ages = [0, 1, 2, 8]
    rows = [(i, now - dt.timedelta(days=a)) for i, a in enumerate(ages)] + [(9, dt.datetime(2023, 3, 1)), (10, dt.datetime(2024, 2, 1))]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    b = df.select("id", paging.date_bucket(F.col("ts"), F.lit(now).cast("timestamp_ntz")).alias("b")).orderBy("b.rank").collect()
    assert [r["b"]["label"] for r in b] == ["Today", "Yesterday", "Previous 7 days", "Previous 30 days", "February", " 2023"]


def test_same_members(spark):
    rows = F.array(F.struct(F.lit(1).alias("a")), F.struct(F.lit(2).alias("a")))
    flip = F.array(F.struct(F.lit(2).alias("a")), F.struct(F.lit(1).alias("a")))
    assert one(spark, sets.same_members(rows, flip)) is True
    assert one(spark, sets.same_members(rows, F.slice(flip, 1, 1))) is False


def test_upsert_keeps_absent_fields(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, y int")
    s = spark.createDataFrame([(2, "c", None), (3, None, 9)], "id int, x string, y int")
    got = sorted(map(tuple, merge.upsert(t, s, ["id"]).collect()))
    assert got == [(1, "a", 5), (2, "c", 6), (3, None, 9)]


def test_effective_access(spark):
    users = spark.createDataFrame([(1, None, "ADMIN"), (2, "ext-2", None)], "user_id bigint, source_id string, role string")
    members = spark.createDataFrame([(7, "ext-2"), (7, "1"), (8, "2")], "group_id bigint, member string")
    p = acl.principals(users, members)
    assert sorted((r["user_id"], r["principal_type"], r["principal_id"]) for r in p.filter("principal_type <> 'public'").collect()) == [
        (1, "group", "7"), (1, "role", "ADMIN"), (1, "user", "1"), (2, "group", "7"), (2, "user", "2"),
    ]
    entries = spark.createDataFrame([("user", 1, 10, 1), ("group", 7, 10, 2), ("group", 7, 11, 3), ("public", None, 12, 1), ("public", None, 10, 4)], "principal_type string, principal_id bigint, resource_id bigint, perm_bits int")
    bits = {(r["user_id"], r["resource_id"]): r["bits"] for r in acl.effective(p, entries).collect()}
    assert bits == {(1, 10): 7, (1, 11): 3, (2, 10): 6, (2, 11): 3, (None, 10): 4, (None, 12): 1}
    personal, public = acl.accessible(p, entries, 3)
    assert sorted(map(tuple, personal.collect())) == [(1, 11), (2, 11)] and public.count() == 0


# --- sources, streams ------------------------------------------------------------------------------------------------


def test_import_node_map(spark):
    doc = (
        '[{"title":"T","create_time":1.5,"mapping":{"r":{"id":"r","message":null,"parent":null},'
        '"s":{"message":{"author":{"role":"system"},"content":{"content_type":"text","parts":[""]},"metadata":{}},"parent":"r"},'
        '"u":{"message":{"author":{"role":"user"},"content":{"content_type":"text","parts":["hi"]},"metadata":{}},"parent":"s"},'
        '"a":{"message":{"author":{"role":"assistant"},"content":{"content_type":"text","parts":["see XX now"]},"metadata":'
        '{"model_slug":"gpt-4","citations":[{"start_ix":4,"end_ix":6,"metadata":{"type":"webpage","title":"W","url":"u"}}]}},"parent":"u"}}}]'
    )
    df = spark.createDataFrame([("d", doc), ("e", "{bad")], "doc string, json string")
    rows = {r["source_id"]: r for r in imports.import_node_map(df, "doc", "json").collect()}
    assert set(rows) == {"u", "a"}
    assert rows["u"]["parent_id"] == imports.NO_PARENT and rows["a"]["parent_id"] == rows["u"]["message_id"]
    assert rows["a"]["text"] == "see  ([W](u)) now" and rows["a"]["sender"] == "GPT-4"


def test_import_tree_drops_empty_subtrees(spark):
    doc = (
        '{"conversationId":"c","title":"t","messagesTree":[{"messageId":"1","text":"a","createdAt":"2024-01-02T00:00:00.000Z","children":['
        '{"messageId":"2","text":"","children":[{"messageId":"3","text":"lost"}]},{"messageId":"4","text":"b","children":[]}]}]}'
    )
    df = spark.createDataFrame([("d", doc)], "doc string, json string")
    head, messages = imports.import_tree(df, "doc", "json")
    assert sorted((r["message_id"], r["parent_id"]) for r in messages.collect()) == [("1", imports.NO_PARENT), ("4", "1")]
    assert head.first()["title"] == "t"


def test_qa_csv(spark, tmp_path):
    path = tmp_path / "qa.csv"
    path.write_text('soru,cevap,kategori,anahtar_kelimeler\n"İzin, nasıl?","Formla\nolur",,izin\nBoş,,genel,\n', encoding="utf-8")
    rows = files.read_qa_csv(spark, str(path)).collect()
    assert [(r["content"], r["category"], r["keywords"]) for r in rows] == [("SORU: İzin, nasıl?\n\nCEVAP: Formla\nolur", "genel", "izin")]


def test_price_list_special_model(spark):
    df = spark.createDataFrame(
        [('{"id":"openrouter/auto","pricing":{"prompt":"-1","completion":"-1"},"context_length":5}',), ('{"id":"m","pricing":{"prompt":"0.000002","completion":"0"},"context_length":9}',)],
        "json string",
    )
    got = {r["id"]: (round(r["prompt"], 6), round(r["completion"], 6), r["context"]) for r in files.price_list(df, "json").collect()}
    assert got == {"openrouter/auto": (10.0, 30.0, 5), "m": (2.0, 0.0, 9)}


def test_stream_ledger_carries_state_over_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 2]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, float(rng.choice([1, -1, 1, -2]))) for i in range(200)]
    shape = "key bigint, ts timestamp_ntz, id bigint, delta double"
    folder = str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], shape).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r["id"]: r["value"] for r in limits.stream_ledger(stream, F.date_trunc("hour", "ts"), "t").collect()}
    state = {}
    for key, _, ident, delta in rows:
        state[key] = max(0.0, state.get(key, 0.0) + delta)
        assert got[ident] == state[key]


def test_balances_with_refill_equal_the_fold(spark, tables):
    from convolake.streaming.runner import table_stream

    costs = lambda df: df.select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("id"), F.col("value").alias("cost"))
    got = {r["id"]: (r["balance"], r["refilled"]) for r in stateful.stream_balances(costs(table_stream(spark, tables.folder, "events")), 500.0, 300.0, 2).collect()}
    state, last = {}, {}
    for r in sorted(costs(tables.events).collect(), key=lambda r: (r["ts"], r["id"])):
        u, c = r["user"], state.get(r["user"], 500.0)
        refill = c - r["cost"] <= 0 and (u not in last or last[u] + dt.timedelta(days=2) <= r["ts"])
        if refill:
            c, last[u] = c + 300.0, r["ts"]
        state[u] = max(0.0, c - r["cost"])
        assert got[r["id"]][1] == refill and math.isclose(got[r["id"]][0], state[u], abs_tol=1e-9)


def test_growing_text():
    sent, unchanged, chunk, done = stateful.grow(0, 0, "First sentence here. And then", False)
    assert (chunk, done) == ("First sentence here.", False)
    sent, unchanged, chunk, done = stateful.grow(sent, unchanged, "First sentence here. And then", False)
    assert chunk is None
    assert stateful.grow(sent, unchanged, "First sentence here. And then end", True)[2:] == ("And then end", True)
    assert stateful.grow(0, stateful.MAX_UNCHANGED, "x" * 50, True)[2] is None


def test_growing_stream_keeps_whole_texts(spark, tables):
    from convolake.plans import ENTRIES

    rows = ENTRIES["st7_growing_text"].run(spark, tables.folder).toPandas()
    joined = rows.sort_values(["key", "seq"]).groupby("key")["chunk"].agg("".join)
    texts = {f"{r['conv_id']}-{r['turn']}": r["text"] for r in tables.conversations.collect()}
    bare = lambda s: "".join(s.split())
    assert {k: bare(v) for k, v in joined.items()} == {k: bare(v) for k, v in texts.items() if v.strip()}
    assert isinstance(rows, pd.DataFrame)


def test_billing_keys_of_every_family(spark):
    expected = {
        "grok-3-mini-beta": "grok-3-mini",
        "grok-4-0709": "grok-4",
        "llama-3.1-70b-instruct": "llama-3.1-70b",
        "us.amazon.nova-lite-v1:0": "amazon.nova-lite-v1:0",
        "us.deepseek.r1-v1:0": "deepseek.r1",
        "ai21.jamba-instruct-v1:0": "ai21.jamba-instruct-v1:0",
        "openai/gpt-oss-20b": "gpt-oss-20b",
        "gpt-4o-mini-2024-07-18": "gpt-4o-mini",
        "kimi-k2": None,
        "qwen2.5:14b": None,
    }
    rows = spark.createDataFrame([(m,) for m in expected], "model string").select("model", billing.billing_key(F.col("model")).alias("key"))
    assert {r.model: r.key for r in rows.collect()} == expected


def test_output_limits_of_model_families(spark, tables):
    from convolake.functions import rates
    from convolake.operators import billing
    from convolake.plans import ENTRIES

    expected = {
        "claude-3-haiku-20240307": 4096, "claude-3-sonnet-20240229": 4096, "claude-3-opus-latest": 4096,
        "claude-opus-4-20250514": 32000, "claude-sonnet-4-20250514": 64000, "claude-3.5-sonnet-v2": 8192,
        "claude-3-5-sonnet-20241022": 8192, "claude-3.7-sonnet": 128000, "claude-3-7-sonnet-latest": 128000,
        "o1-2024-12-17": 32268, "o1-mini": 65136, "o1-preview-2024": 32268, "gpt-5-nano-x": 128000, "gpt-oss-20b": 131000,
    }
    rows = spark.createDataFrame([(m,) for m in expected], "model string")
    limit = billing.looked_up(billing.contained(F.col("model"), list(rates.OUTPUT_LIMITS)), rates.OUTPUT_LIMITS)
    assert {r.model: r.n for r in rows.select("model", limit.alias("n")).collect()} == expected
    got = {r.model: r.output for r in ENTRIES["b10_token_limits"].run(spark, "/root/testdata/sf0.001").collect()}
    assert got["claude-3-5-sonnet-20241022"] == 8192 and got["claude-3-haiku"] == 4096 and got["gpt-4o-mini-2024-07-18"] == 1024


def test_counted_terms_are_those_of_the_expression(spark):
    import numpy as np
    import pyarrow as pa

    from convolake.functions import vectors as V

    rng = random.Random(9)
    pieces = ["the", "Word", "çığ", "İstanbul", "naïve", "a_b", "12345", "007", "4294967295", "4294967294", "ab", "ışı", " ", "\n", "\x85", "é", "Ω", "𝒳yz", "-"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "-"]) for _ in range(rng.choice([1, 5, 40]))) for _ in range(200)]
    texts += ["", None, "c" * 5000, " ".join(f"t{i} {10**6 - i}" for i in range(300)) + " t299 t1 1000000"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, text string")
    want = {r.k: r.d or [] for r in df.select("k", V.term_dims(F.col("text")).alias("d")).collect()}
    got = {r.k: r.vector for r in with_hashed_vector(df, "k", "text").collect()}
    for k, dims in want.items():
        counts = np.bincount(np.array(dims, np.int64), minlength=200)
        assert np.allclose(got[k], counts / (np.sqrt((counts * counts).sum()) or 1), atol=1e-12), texts[k]
    terms = df.select("k", F.explode(X.vector_terms(F.col("text"))).alias("term")).groupBy("k", "term").agg(F.count("*").alias("tf"))
    counted = V.term_counts(df, "k", "text")
    assert terms.exceptAll(counted).count() == 0 and counted.count() == terms.count()
    # slices bound what is held: a batch is never looked at whole
    assert [p.num_rows for p in V.parts(pa.record_batch({"k": [1, 2, 3, 4], "t": ["x" * 100] * 4}), 250)] == [2, 2]


def test_keyword_scan_keeps_the_best_of_a_task(spark, tables):
    questions = tables.benchmark.select(F.col("item_id").alias("q_id"), "text")
    docs = tables.documents.select("doc_id", "text").coalesce(1)
    order = [F.desc(F.col("hits") + F.when(F.col("is_long"), 0.5).otherwise(0.0)), F.asc("doc_id")]
    best = lambda df: sorted(map(tuple, retrieve.top_per(df, ["q_id"], order, 5).collect()))
    every, few = retrieve.keyword_hits(questions, docs), retrieve.keyword_hits(questions, docs, 5)
    assert best(every) == best(few) and few.count() < every.count()
