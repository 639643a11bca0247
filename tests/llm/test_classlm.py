"""The class model against plain sequential versions: gains of moves, pair counts, scores, and that probabilities add to one."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolake.llm import classlm

CORE, CLASSES, VOCABULARY = 12, 4, 120


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(60)] + [f"Z{i}" for i in range(400)]
    weights = [1 / (1 + i) for i in range(len(pool))]
    rows = [(i, " ".join(rng.choices(pool, weights, k=rng.randint(0, 90))), "x") for i in range(80)]
    rows += [(80, None, "x"), (81, "", "x"), (None, "w1 w2 never", "x"), (82, "never seen " * 30, "x"), rows[3], (83, rows[4][1], "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, learn string"), rows


def likelihood(pairs):
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0).sum()
    return f(pairs) - f(pairs.sum(0)) - f(pairs.sum(1))


def counted(texts, group, classes):
    """Pairs of classes by a plain count; a word that ``group`` lacks is one of the rest."""
    pairs = np.zeros((classes + 2, classes + 2))
    for t in texts:
        s = [classes, *[group.get(w, classes + 1) for w in t], classes]
        for a, b in itertools.pairwise(s):
            pairs[a, b] += 1
    return pairs


def test_gains_are_differences_of_the_likelihood():
    """A word that does not stand beside words of its old or new class: the gain is exact."""
    rng = random.Random(1)
    group = {f"a{i}": 0 for i in range(5)} | {f"b{i}": 1 for i in range(5)} | {f"c{i}": 2 for i in range(20)}
    others = [w for w in group if w[0] == "c"]
    texts = [[w for _ in range(30) for w in (rng.choice(others), rng.choice(list(group)), rng.choice(others))] for _ in range(6)]
    pairs = counted(texts, group, 3)
    near = collections.Counter()
    for t in texts:
        for a, b in itertools.pairwise([None, *t, None]):
            if b == "a1":
                near[0, group.get(a, 3)] += 1
            if a == "a1":
                near[1, group.get(b, 3)] += 1
    keys = sorted(near)
    side, cls = (np.array(x) for x in zip(*keys))
    n = np.array([near[k] for k in keys])
    moved = likelihood(counted(texts, group | {"a1": 1}, 3)) - likelihood(pairs)
    gains = classlm.Gains(pairs, 2)
    _, best = gains.best(np.zeros(len(n), int), side, cls, n, np.zeros(len(n), int))
    assert (best[0] == 1) == (moved > 1e-9)
    # Larger counts than those looked up, in both directions.
    _, back = classlm.Gains(counted(texts, group | {"a1": 1}, 3), 2).best(np.zeros(len(n), int), side, cls, n, np.ones(len(n), int))
    assert (back[0] == 0) == (moved < -1e-9)


def test_rounds_raise_the_likelihood(docs):
    frame, rows = docs
    learn = frame.select("doc_id", "text", F.lit(True).alias("learn"), F.lit(True).alias("scored"))
    texts = [(t or "").lower().split() for _, t, _ in rows]
    counts = collections.Counter(w for t in texts for w in t)
    words = sorted((w for w in counts if counts[w] >= 2), key=lambda w: (-counts[w], w))
    group, pairs = classlm.classed(classlm.encoded(learn, words), len(words), sum(counts.values()) + len(rows), CORE, CLASSES)
    of = {w: int(group[i]) for i, w in enumerate(words, 1)}
    assert set(of.values()) <= set(range(CLASSES)) and (pairs == counted(texts, of, CLASSES)).all()
    first = {w: i % CLASSES for i, w in enumerate(words)}
    assert likelihood(pairs) > likelihood(counted(texts, first, CLASSES))


@pytest.mark.parametrize("vocabulary", [VOCABULARY, 900_000])
def test_scores_by_a_plain_count(docs, vocabulary):
    """Each word's class is taken from the operator, everything else is counted anew."""
    frame, rows = docs
    is_learned = lambda i: i is not None and i % 4 != 1
    learned = [(t or "").lower().split() for i, t, _ in rows if is_learned(i)]
    counts = collections.Counter(w for t in learned for w in t)
    n = sum(counts.values()) + len(learned)
    words = sorted((w for w in counts if counts[w] >= 2 and counts[w] * vocabulary >= n), key=lambda w: (-counts[w], w))
    marked = frame.select("doc_id", "text", F.coalesce(F.col("doc_id") % 4 != 1, F.lit(False)).alias("learn"), F.lit(True).alias("scored"))
    texts = classlm.encoded(marked, words)
    group, pairs = classlm.classed(texts.filter("learn"), len(words), n, CORE, CLASSES)
    end, unknown = CLASSES, CLASSES + 1
    core = {w: int(group[i]) for i, w in enumerate(words, 1)}
    rare = {r["word"]: r for r in classlm.rare_classes(texts, group, pairs, CLASSES).collect()}
    assert rare.keys() == {w for _, t, _ in rows for w in (t or "").lower().split()} - core.keys()
    assert all(r["c"] == counts[w] and (r["class"] == unknown) == (r["c"] <= 1) for w, r in rare.items())
    assert all(r["crowd"] == sum((t or "").lower().split().count(w) for _, t, _ in rows) for w, r in rare.items())
    of = core | {w: r["class"] for w, r in rare.items()}
    moves, size = collections.Counter(), collections.Counter()
    for t in learned:
        for a, b in itertools.pairwise([None, *t, None]):
            moves[end if a is None else core.get(a, unknown), end if b is None else of[b]] += 1
    for (_, k), m in moves.items():
        size[k] += m
    total, m = sum(size.values()), CLASSES + 2
    out = collections.Counter()
    for (a, _), c in moves.items():
        out[a] += c

    def step(a, k):
        share = (size[k] + 0.5) / (total + 0.5 * m)
        return (moves[a, k] + classlm.BACKOFF * share) / (out[a] + classlm.BACKOFF)

    def emission(w):
        if of[w] == unknown:
            return (counts[w] + 0.5) / (size[unknown] + 0.5 * (size[unknown] + 1))
        return counts[w] / size[of[w]]

    for a in range(m):  # an unknown word counts as one kind, like in the base
        known = sum(step(a, of[w]) * emission(w) for w in counts)
        empty = sum(step(a, k) for k in range(CLASSES) if not size[k])
        assert math.isclose(known + empty + step(a, end) + step(a, unknown) * 0.5 / (size[unknown] + 0.5 * (size[unknown] + 1)), 1, abs_tol=1e-9)
    want = collections.Counter()
    for i, t, _ in rows:
        t = (t or "").lower().split()
        p = sum(math.log10(step(end if a is None else core.get(a, unknown), of[b]) * emission(b)) for a, b in itertools.pairwise([None, *t]))
        p += math.log10(step(core.get(t[-1], unknown) if t else end, end))
        want[i, len(t) + 1, sum(w in counts for w in t) + 1, round(p, 5)] += 1
    for train in (F.col("doc_id") % 4 != 1, frame.filter("doc_id % 4 <> 1")):
        got = classlm.scores(frame, train, core=CORE, classes=CLASSES, vocabulary=vocabulary).collect()
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.score, 5)) for r in got) == want


def test_edges(spark, docs):
    frame, rows = docs
    none = classlm.scores(frame, F.lit(False)).collect()  # nothing to learn from
    assert len(none) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and r.score < 0 for r in none)
    assert classlm.scores(frame.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="vocabulary"):
        classlm.scores(frame, F.lit(True), vocabulary=1 << 30)
    assert [classlm.classes_for(n) for n in (0, 390_000, 80_000_000)] == [1, 34, 83]
