"""Quality by weak supervision, with DataFrame operations only.

Rules vote good (1), bad (-1) or abstain (0) on statistics of the whole text. Expectation-maximisation over the vote
patterns (at most 3 ** rules rows, counted by one aggregation) estimates how each rule votes on good texts and on texts
with each kind of fault, and how many there are of each; the posterior probability of being good decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import WHITE_CLASS, without_white, written

SYMBOLS = "#*$%&|<>"
ROUNDS = 25
KEEP_FROM = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: equal hashes are neighbours once sorted."""

    def of_sorted(pairs: Column) -> Column:
        repeated = F.filter(
            pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))
        )
        starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last")),
            lambda a, x: F.struct((a["total"] + F.least(F.lit(3), x - a["last"])).alias("total"), x.alias("last")),
            lambda a: a["total"],
        )

    return let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)


def repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text, the first included."""

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, of_hashes))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, of every whole text; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            repeat_words(words).cast("bigint").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    words = F.filter(F.split(text, f"{WHITE_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = F.length(text)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(without_white(text)).cast("bigint").alias("word_chars"),
        (length - F.length(without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
        (length - F.length(without(text, "!"))).cast("bigint").alias("n_exclamations"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("bigint").alias("n_capitals"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_exclamations", "n_capitals")


def vote(bad: Column, good: Column | None = None) -> Column:
    votes = F.when(bad, -1)
    return (votes if good is None else votes.when(good, 1)).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """A vote of each rule; ratios are compared by products, so that nothing is divided by zero.

    Rules that look for a fault abstain where they find none; signs of the same fault make one rule, because the model
    takes rules as independent given the class.
    """
    c = F.col
    words = c("n_words")
    return {
        "length": vote(words == 0, words >= 100),
        "word_length": vote((c("word_chars") < 2 * words) | (c("word_chars") > 12 * words), c("word_chars").between(3 * words, 9 * words)),
        "symbols": vote(8 * c("n_symbols") > words),
        "shouting": vote((8 * c("n_exclamations") > words) | (4 * c("n_capitals") > c("word_chars"))),
        "repetition": vote(
            (4 * c("n_distinct") < words) | (2 * c("n_dup_lines") > c("n_lines")) | (9 * c("n_repeat_words") > 4 * words)
        ),
    }


GOOD = "good"
# Where fitting starts: a rule hardly ever finds its fault in good texts, mostly finds it in texts that have it, and now
# and then finds it in texts with another fault. Votes bad, abstains, votes good.
START_GOOD = {-1: 0.005, 0: 0.395, 1: 0.6}
START_OWN = {-1: 0.8, 0: 0.15, 1: 0.05}
START_OTHER = {-1: 0.1, 0: 0.4, 1: 0.5}
START_SHARE = 0.8
START_WEIGHT = 0.02  # of a class's rows, how many the starting values stand for

Model = tuple[dict[str, dict[str, dict[int, float]]], dict[str, float]]  # class, rule, vote: how often; share of a class


def start(names: list[str]) -> Model:
    """Good texts and one class of bad ones per rule, since faults seldom come together."""
    votes = {GOOD: dict.fromkeys(names, START_GOOD)}
    votes |= {kind: {m: START_OWN if m == kind else START_OTHER for m in names} for kind in names}
    return votes, {c: START_SHARE if c == GOOD else (1 - START_SHARE) / len(names) for c in votes}


def _likelihood(votes: dict[str, dict[int, float]], share: float) -> Column:
    logs = F.lit(math.log(share))
    for name, p in votes.items():
        logs += F.when(F.col(name) == 1, math.log(p[1])).when(F.col(name) == -1, math.log(p[-1])).otherwise(math.log(p[0]))
    return F.exp(logs)


def posteriors(model: Model) -> dict[str, Column]:
    """Probability of each class given the votes of a row."""
    votes, shares = model
    each = {c: _likelihood(votes[c], shares[c]) for c in votes}
    total = sum(each.values(), F.lit(0.0))
    return {c: x / total for c, x in each.items()}


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> Model:
    """How each rule votes on texts of each class, and the share of each class, from all rows.

    The rows are counted by vote pattern; the iterations run over those counts, at most 3 ** rules of them. An empty
    table leaves the starting values.
    """
    patterns = [([r[m] for m in names], r["count"]) for r in votes.groupBy(*names).count().orderBy(*names).collect()]
    model, first = start(names), start(names)[0]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        rates, shares = model
        sizes = dict.fromkeys(rates, 0.0)
        seen = {c: {m: dict.fromkeys(START_GOOD, 0.0) for m in names} for c in rates}
        for cast, n in patterns:
            p = {c: shares[c] * math.prod(rates[c][m][v] for m, v in zip(names, cast, strict=True)) for c in rates}
            whole = sum(p.values())
            for c in rates:
                sizes[c] += n * p[c] / whole
                for m, v in zip(names, cast, strict=True):
                    seen[c][m][v] += n * p[c] / whole

        def share(c: str, m: str, sizes=sizes, seen=seen) -> dict[int, float]:
            weight = START_WEIGHT * sizes[c] + 1
            return {v: (seen[c][m][v] + weight * p) / (sizes[c] + weight) for v, p in first[c][m].items()}

        model = {c: {m: share(c, m) for m in names} for c in rates}, {c: (sizes[c] + 1) / (total + len(rates)) for c in rates}
    return model


def quality(docs: DataFrame, keep_from: float = KEEP_FROM, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the statistics, a vote per rule and ``quality``, the posterior probability of a good text.

    A null text counts as empty and is voted on like any other; a null doc_id stays null; repeated rows are counted
    as often as they occur; an empty table gives an empty result.
    """
    named = rules()
    voted = written(text_statistics(docs).withColumns({f"vote_{k}": v for k, v in named.items()}), "votes")
    names = [f"vote_{k}" for k in named]
    return voted.withColumn("quality", posteriors(fit(voted, names, rounds))[GOOD]).withColumn("good", F.col("quality") >= keep_from)
