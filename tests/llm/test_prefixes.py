"""The prefix trie against a plain one, and the centroid decomposition at all part sizes."""

import hashlib
import random
import zlib

import pytest

from convolake.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, span string, weight string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def expected(rows):
    """Rows of a conversation must have different turns, or be equal where turns are."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    children, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        if path:
            children.setdefault(path[:-1], []).append(path)
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = sum(saved[k] for k in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    found = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c, last in sorted(convs) if last)
        parent = min(members[path[:-1]])[0] if path else None
        found.append((min(convs)[0], len(path), parent, len(convs), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(2)
    word = lambda: rng.choice(["", "a", "bé", "ccc"])
    role = lambda: rng.choice(["user", "assistant", None])
    rows = []
    for c in [*range(0, 60), *range(100, 130), 250, 251, -7, -100, 100_000_000_000]:
        rows += [(c, 3 * t, role(), word()) for t in range(rng.randint(1, 8))]
    rows += [(300, t, "user", "long") for t in range(2500)]  # longer than a span
    rows += [(300 + i, t, "user", "long") for i in range(1, 8) for t in range(rng.choice([40, 1200, 2500]))]
    rows += [(c, t, "user", "same") for c in range(400, 440) for t in range(4)]  # copies
    rows += [(60, None, None, None), (60, 1, "user", "x"), (61, None, "a", "b"), (61, 0, "", None), (61, 7, None, "y" * 100_000)]
    rows += [(62, 1, "user", "twice"), (62, 1, "user", "twice"), (None, 1, "user", "x"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("least_part", [prefixes.LEAST_PART, 500, 1])
def test_trie(spark, conversations, least_part):
    rows = [r for r in conversations if least_part > 1 or r[0] is None or not 300 <= r[0] < 400]
    assert got(prefixes.prefix_trie(frame(spark, rows), least_part)) == expected(rows)


def test_centroids():
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 400):
        for shape in ("chain", "star", "random", "forest"):
            parent = [-1] + [{"chain": i - 1, "star": 0, "random": rng.randrange(i), "forest": rng.randrange(-1, i)}[shape] for i in range(1, n)]
            values = [[rng.randint(-5, 9) for _ in range(n)] for _ in range(2)]
            want = [list(v) for v in values]
            for v in range(n - 1, 0, -1):
                if parent[v] >= 0:
                    for column in want:
                        column[parent[v]] += column[v]
            assert prefixes._centroids(parent, values) == want


def test_lines_of_ids(spark, monkeypatch):
    """Ids of one key go through many lines."""
    monkeypatch.setattr(prefixes, "LINE", 100)
    ids = [7 * i - 500 for i in range(300)]
    rows = [(1, 2, 3, i) for i in ids] + [(1, 2, 4, 5), (0, 0, 0, -1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "depth bigint, p1 bigint, p2 bigint, conv_id bigint").repartition(5)
    found = {tuple(r)[:3]: r.ends_sha256 for r in prefixes.joined_ids(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == {(1, 2, 3): sha(",".join(map(str, ids))), (1, 2, 4): sha("5"), (0, 0, 0): sha("-1")}


def test_empty(spark):
    assert got(prefixes.prefix_trie(frame(spark, []))) == []
    assert got(prefixes.prefix_trie(frame(spark, [(None, 1, "user", "x")]))) == []
    rows = [(1005, 0, "user", "x")]  # the crc32 of 1005 leaves no turn of its own, or one
    assert got(prefixes.prefix_trie(frame(spark, rows))) == expected(rows)
