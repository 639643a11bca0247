"""SimHash fingerprints and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from convolake.llm import queries, simhash

SCHEMA = "doc_id bigint, text string, fingerprint string, root string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + k] for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, budget=3):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values, last = np.array(prints, np.uint64), {}
    for i, (doc, _) in enumerate(rows):
        if doc is None:
            continue
        near = np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= budget).tolist()
        for j in [*near, *last.get(doc, [])]:
            if rows[j][0] is not None:
                parent[find(j)] = find(i)
        last.setdefault(doc, []).append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    found = [(d, f"{p:016x}", None if d is None else least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))]
    return sorted(found, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdEFGH") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "two words"), (None, " ".join(base)), (7, "é ü " * 40), (8, "tie tie  tie\ntie")]
    for i in range(10, 90):
        near = list(base)
        for at in rng.sample(range(400), rng.randint(0, 8)):
            near[at] = word()
        rows.append((i, ("\n" if i % 3 else "  ").join(near)))
    rows += [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(90, 200)]
    rows += [(90, " ".join(base[:200])), (90, " ".join(base[200:])), (300, " ".join(word() for _ in range(70_000)))]
    return [*rows, rows[20]]


@pytest.mark.parametrize("leaf", [simhash.LEAF, 30])
def test_components(spark, corpus, leaf):
    want = expected(corpus)
    assert len({w[1] for w in want}) > len({w[2] for w in want}) + 5  # links between different fingerprints
    assert got(simhash.near_fingerprints(frame(spark, corpus), leaf=leaf)) == want


def test_walk_finds_every_pair():
    """Dense and sparse tries, within one and between two subtries, with a frontier that has to be cut."""
    rng = np.random.default_rng(1)
    dense = np.uint64(0xAAAA5555F0F00FF0)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 4)).astype(np.uint64), axis=1)
    values = np.unique(np.concatenate([rng.integers(0, 2**63, 300).astype(np.uint64), dense ^ flips, np.array([0, 2**64 - 1], np.uint64)]))
    differ = np.bitwise_count(values[:, None] ^ values[None, :])
    for budget in (0, 1, 3):
        for level in (0, 1):
            parts = [values] if not level else [values[values < 2**63], values[values >= 2**63]]
            pairs = [(parts[0], parts[0]), (parts[-1], parts[-1])] + ([tuple(parts)] if level else [])
            found = set()
            for x, y in pairs:
                a = simhash._Trie(x, level)
                b = a if x is y else simhash._Trie(y, level)
                for i, j in simhash._walk(a, b, level, budget, frontier=50):
                    found |= {frozenset(p) for p in zip(x[i].tolist(), y[j].tolist(), strict=True)}
            i, j = np.nonzero(np.triu(differ <= budget, 1))
            assert found == {frozenset(p) for p in zip(values[i].tolist(), values[j].tolist(), strict=True)}


def test_empty(spark):
    assert got(simhash.near_fingerprints(frame(spark, []))) == []
    assert got(simhash.near_fingerprints(frame(spark, [(None, "a b c")]))) == [(None, f"{fingerprint('a b c'):016x}", None)]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op13_simhash_near_dedup(spark, folder)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert got(df) == expected(rows)
