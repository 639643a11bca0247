"""Toxicity of texts whose words may be disguised: a noisy channel restores them, a linear model scores them.

A disguised word (digits and signs for letters, letters repeated or set apart) is a lattice: each character stands for
itself, for letters it is used for, or for nothing. Characters set apart are one lattice in which a separator is nothing
or the end of a word, so a run may be several words. Viterbi decoding under a character trigram model of all texts picks
the likeliest words. Words that are plain letters without doubled ones have one path, themselves, and are not decoded. The
score is a logistic regression on restored words and their beginnings, fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import id_and_text, slices, written

TRAIN_ROWS = 12_000  # labelled rows the classifier is fitted on, at most
FEATURES = 600
CACHED = 60  # characters of a token whose decoding is kept
PREFIXES = (3, 4, 5, 6)

# Letters that digits and signs are used for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SUBSTITUTED, DROPPED_REPEAT, DROPPED_SIGN = -2.0, -1.0, -0.5  # log probabilities of the channel's steps

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SYMBOLS = len(LETTERS) + 2  # boundary, letters, any other letter
_SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
_SIGNS = re.escape("".join(STANDS_FOR))
_APART = re.compile(rf"(?<![^\W_])(?:(?:([^\W\d_])\1*|[{_SIGNS}])[\s.\-_*]+){{2,}}(?:([^\W\d_])\2*|[{_SIGNS}])(?![^\W_])")
_GAP = re.compile(r"[\s.\-_*]+")
GAP_DROPPED, GAP_KEPT = -0.5, -0.5  # log probabilities of a separator in a run: within a word, between words
_TOKEN = re.compile(r"[^\s,;:?\"“”«»#%&]+")
_PLAIN = re.compile(r"[^\W\d_]+")
_DOUBLED = re.compile(r"(.)\1")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n) of the character trigrams of all texts; at most ``SYMBOLS ** 3`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(256, np.int64)
        for c, i in _SYMBOL.items():
            table[ord(c)] = i
        total = np.zeros(SYMBOLS**3, np.int64)
        for _, texts in slices(batches):
            codes = np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            s = np.where(codes < 256, table[np.minimum(codes, 255)], SYMBOLS - 1)
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(total[code], pa.int64())], names=["0", "1"])

    return id_and_text(docs).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class Restorer:
    """Viterbi decoding of disguised words under the trigram model."""

    def __init__(self, trigrams: np.ndarray):
        counts = trigrams.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pair = counts.sum(0)
        single = pair.sum(0)
        one = (single + 1) / (single.sum() + SYMBOLS)
        two = (pair + 20 * one) / (pair.sum(1, keepdims=True) + 20)
        self.log = np.log((counts + 20 * two) / (counts.sum(2, keepdims=True) + 20))
        self.seen: dict[str, str] = {}

    def word(self, token: str) -> str:
        if len(token) > CACHED:
            return self._decode(token)
        known = self.seen.get(token)
        if known is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            known = self.seen[token] = self._decode(token)
        return known

    def _decode(self, token: str) -> str:
        # State: the last two symbols; value: log probability and the words so far.
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        before = ""
        for c in _GAP.sub(" ", token):
            then: dict[tuple[int, int], tuple[float, str]] = {}
            if c == " ":
                for (a, b), (score, word) in paths.items():
                    if score + GAP_DROPPED > then.get((a, b), (-math.inf, ""))[0]:
                        then[a, b] = score + GAP_DROPPED, word
                    new = score + GAP_KEPT + self.log[a, b, 0]
                    if b and new > then.get((b, 0), (-math.inf, ""))[0]:
                        then[b, 0] = new, word + " "
                paths = then
                continue
            is_letter = c.isalpha()
            steps = [(c, 0.0)] if is_letter else [(x, SUBSTITUTED) for x in STANDS_FOR.get(c, "")]
            for (a, b), (score, word) in paths.items():
                for letter, cost in steps:
                    s = _SYMBOL.get(letter, SYMBOLS - 1)
                    new = score + cost + self.log[a, b, s]
                    if new > then.get((b, s), (-math.inf, ""))[0]:
                        then[b, s] = new, word + letter
                drop = DROPPED_REPEAT if is_letter and c == before else None if is_letter or c.isdigit() else DROPPED_SIGN
                if drop is not None and score + drop > then.get((a, b), (-math.inf, ""))[0]:
                    then[a, b] = score + drop, word
            if then:
                paths = then
            before = c
        return max(((score + self.log[a, b, 0], word) for (a, b), (score, word) in paths.items()), key=lambda x: x[0])[1]

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        text = text.lower()
        found = set()
        for run in _APART.finditer(text):
            if _PLAIN.search(run.group()):
                found.update(self.word(run.group()).split())
        for token in set(_TOKEN.findall(text)):
            core = token.strip(".!*$'()[]{}<>|/\\-_+=~`^")
            if not core:
                continue
            if _PLAIN.fullmatch(core):
                found.add(core)
                if _DOUBLED.search(core):
                    found.add(self.word(core))
                continue
            if re.search(r"[^\W\d_]", core):
                found.update(self.word(core).split())
            found.update(_PLAIN.findall(core))
        return found


def features(words: set[str]) -> list[int]:
    names = {f"={w}" for w in words}
    for k in PREFIXES:
        names.update([f"^{w[:k]}" for w in words if len(w) >= k])
    return [xxhash.xxh64_intdigest(n) - 2**63 for n in names]


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, restorer: Restorer, train_rows: int, n_features: int) -> tuple[dict[int, float], float]:
    """Feature weights and intercept from labelled rows that are not held out; no labels: no weights, even odds."""
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(3) != 1))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, toxic, texts in slices(batches):
            found = [features(restorer.words(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["0", "1", "2"])

    seen = written(rows.mapInArrow(run, "doc_id bigint, toxic int, features array<bigint>"), "toxic-features")
    sizes = seen.agg(F.count("*"), F.sum("toxic")).first()
    n, n1 = sizes[0], sizes[1] or 0
    if not n:
        return {}, 0.0
    each = seen.select("toxic", F.explode("features").alias("f"))
    counts = each.groupBy("f").agg(F.sum("toxic").alias("k1"), F.count("*").alias("k")).filter("k1 >= 2")
    # How much more toxic rows have it than chance would give: the log likelihood ratio of the toxic share.
    rate, base = F.col("k1") / F.col("k"), (n1 + 0.5) / (n + 1)
    gain = F.col("k1") * F.log(rate / base) + F.when(rate < 1, (F.col("k") - F.col("k1")) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    best = [r["f"] for r in counts.filter(rate > base).orderBy(gain.desc(), "f").limit(n_features).collect()]
    place = {f: i for i, f in enumerate(best)}
    chosen = F.array(*[F.lit(f) for f in best]) if best else F.array().cast("array<bigint>")
    x, y = np.zeros((n, len(best)), np.float32), np.zeros(n)
    for i, r in enumerate(seen.select("toxic", F.array_intersect("features", chosen).alias("f")).toLocalIterator()):  # at most train_rows
        y[i] = r["toxic"]
        x[i, [place[f] for f in r["f"]]] = 1
    w = fit_logistic(x, y)
    return {f: float(w[i]) for f, i in place.items()}, float(w[-1])


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, n_features: int = FEATURES) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``.

    A null or empty text has the score of a text without any known feature; a null doc_id stays null; repeated rows are
    scored alike; an empty table gives an empty result. Only ids and the column toxic of ``labels`` are read.
    """
    trigrams = np.zeros(SYMBOLS**3, np.int64)
    for r in trigram_counts(docs).toLocalIterator():  # at most SYMBOLS ** 3 rows
        trigrams[r["code"]] = r["n"]
    restorer = Restorer(trigrams)
    weights, intercept = train(docs, labels, restorer, train_rows, n_features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            scores = []
            for t in texts:
                z = intercept + sum(weights.get(f, 0.0) for f in features(restorer.words(t)))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["0", "1"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, from_score: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``from_score``; rows without doc_id stay."""
    rejected = toxicity(docs, labels).filter(F.col("score") >= from_score).select("doc_id").distinct()
    return docs.join(written(rejected, "rejected"), "doc_id", "left_anti").select(*docs.columns)
