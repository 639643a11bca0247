"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

from convolake.llm import lexical

DOCS = "doc_id bigint, text string, term string, m string, segment string, n string"
ITEMS = "item_id bigint, text string, term string, w string"


def terms(text):
    lowered = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    rows = []
    for item, words in asked.items():
        found = []
        for doc, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if t in c
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:top], 1)]
    return sorted(rows, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in docs], DOCS).repartition(3),
        spark.createDataFrame([(i, t, "a", "b") for i, t in items], ITEMS),
    )


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    pick = lambda n: " ".join(words[int(300 * rng.random() ** 3)] for _ in range(n))
    docs = [(i, pick(rng.choice([3, 5, 5, 5, 20, 60]))) for i in range(200)]
    docs += [(200, None), (201, ""), (202, " !? _ "), (None, pick(10)), (203, "Ä-Ö x_Y\tÉ" * 3), (204, pick(20_000))]
    docs += [(i, docs[3][1]) for i in range(300, 340)]  # ties, and a crowded stratum
    docs += [docs[5], docs[5], (5, pick(7))]
    items = [(i, pick(rng.randint(1, 12))) for i in range(30)]
    items += [(30, docs[3][1]), (31, None), (32, ""), (33, "unheard"), (34, "X y Ä Ö É"), (None, words[0]), (0, words[7]), items[4]]
    return docs, items


@pytest.mark.parametrize("segment_bytes", [1 << 25, 10_000])
def test_search(spark, tables, segment_bytes):
    docs, items = frames(spark, *tables)
    index = lexical.build_index(docs, segment_bytes)
    assert (index.segments > 5) == (segment_bytes == 10_000)
    assert got(lexical.search(index, items)) == expected(*tables)
    if index.segments > 5:
        assert got(lexical.search(index, items, top=3, block_items=10)) == expected(*tables, top=3)


def test_index_holds_every_posting(spark, tables):
    docs, items = frames(spark, *tables)
    index = lexical.build_index(docs, 10_000)
    held = Counter()
    members = {r.segment: r for r in index.members.collect()}
    for r in index.postings.collect():
        assert sum(r["size"]) == len(r.docs) and list(zip(r.m, (-t for t in r.tf))) == sorted(zip(r.m, (-t for t in r.tf)))
        at = 0
        for m, tf, size in zip(r.m, r.tf, r["size"]):
            for d in r.docs[at : at + size]:
                assert members[r.segment].m[d] == m
                held[members[r.segment].doc_ids[d], r.term, tf] += 1
            at += size
    want = Counter((lexical.NO_ID if i is None else i, t, n) for i, text in tables[0] for t, n in Counter(terms(text)).items())
    assert held == want


def test_strata_are_skipped():
    """Strata whose bound stays below the floor are not visited, whatever they hold."""
    import numpy as np

    m = np.repeat([10, 100, 1000], 20)
    strata, to = np.unique(m, return_index=True)
    term = lexical._Term(np.array([10, 100, 1000]), np.array([1, 1, 1]), np.array([20, 20, 20]), np.arange(60, dtype=np.int32), strata)
    seen = []
    within = lexical._Term.within
    term.within = lambda wanted: seen.append(wanted.tolist()) or within(term, wanted)
    docs, scores = lexical._search([(term, 5)], np.arange(60), np.append(to, 60), 1, 10, False)
    assert docs.tolist() == list(range(10)) and len(set(scores.tolist())) == 1
    assert 2 not in sum(seen, [])


def test_empty(spark):
    docs, items = frames(spark, [], [(1, "a b")])
    assert got(lexical.search(lexical.build_index(docs), items)) == []
    docs, items = frames(spark, [(1, "a")], [])
    assert got(lexical.search(lexical.build_index(docs), items)) == []
