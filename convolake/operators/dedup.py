"""Near-duplicate removal: keep the first text, drop later ones whose word sets overlap with a kept one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from convolake.functions import fixed
from convolake.functions.text import jaccard, trim_space, word_set
from convolake.session import cut_lineage, fresh_path

FRONT = 256  # texts of one key that are compared among each other in one round
CELLS = 1 << 22  # counters of word frequencies; they only order the words of a set
FEW = 2  # a word counted more often is a key only together with another one
TOKENS = 1 << 19  # words whose keys are made at a time, as arrays of a fixed size
MIX = np.uint64(0x9E3779B97F4A7C15)


def _stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: columns of words and keys take a fraction of a checkpoint's bytes."""
    path = fresh_path(df.sparkSession, "similar")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_sets(df: DataFrame, group: str, key: str, text: str, min_chars: int) -> DataFrame:
    """(group, key, words, n): one row per distinct word set of a group, under its first key; words sorted, joined by a space."""
    return (
        df.filter(F.length(trim_space(F.col(text))) >= min_chars)
        .select(F.col(group).alias("g"), F.col(key).alias("k"), F.array_join(F.sort_array(word_set(F.col(text))), " ").alias("words"))
        # texts without words are similar to nothing, so each of them stays a row of its own
        .groupBy("g", "words", F.when(F.col("words") == "", F.col("k")).alias("_own"))
        .agg(F.min("k").alias("k"))
        .select("g", "k", "words", F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " "))).alias("n"))
    )


def _least(n: np.ndarray, threshold: float) -> np.ndarray:
    """The words a set of ``n`` shares at least with a similar one; also the size of the smallest similar one."""
    return np.ceil(n * threshold - 1e-9).astype(np.int64)


def _groups(n: np.ndarray, threshold: float) -> np.ndarray:
    """Groups that the words of a set of ``n`` are dealt to, about a fifth to a tenth of it; 0 if every word is a key of its own."""
    power = 1 << np.log2(np.maximum(n, 1)).astype(np.int64)
    return np.maximum(0, np.minimum(power // 5, (_least(n, threshold) - 1) // 3))


def _keys(h: np.ndarray, seen: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, pos) of sets of ``n`` words each, given as hashes ``h`` in one order that all sets share, rare ones first.

    A rare word is a key. The others are dealt to groups by hash, and two of a group are a key. A word counts one if it is rare or
    not the first of its group; taking a word from a set lowers the sum of these counts by one at most. Sets of n and m
    words, i of them common, miss n - i and m - i words; take each set's words in order until the sum is one more than it
    misses. Of the set that ends first, common words that sum to one remain, hence a rare word or two of a group, and the other set
    takes them too. ``pos`` is the sum before the key's last word, at most what the set misses.
    The number of groups is that of the smaller set, so a set is dealt once for each number its smaller partners may have.
    """
    row = np.repeat(np.arange(len(n)), n)
    least = _least(n, threshold)
    low, high = _groups(least, threshold), _groups(n, threshold)
    rows, keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for m in np.unique(_groups(np.arange(1, n.max(initial=1) + 1), threshold)):
        dealt = (low <= m) & (m <= high)
        at = np.flatnonzero(dealt[row])
        if not len(at):
            continue
        r, w = row[at], h[at].view(np.uint64)
        rare = (seen[at] <= FEW) | (m == 0)
        group = np.where(rare, -1 - np.arange(len(at)), r * max(m, 1) + (w >> np.uint64(32)).astype(np.int64) % max(m, 1))
        by = np.argsort(group, kind="stable")
        counts = np.ones(len(at), bool)
        counts[by[np.r_[True, group[by][1:] != group[by][:-1]]]] = False
        counts |= rare
        before = np.cumsum(counts) - counts
        sizes = n[dealt]
        before -= np.repeat(before[np.cumsum(sizes) - sizes], sizes)
        used = before <= (n - least)[r]
        # a word counted once meets nothing
        alone = used & rare & (seen[at] > 1)
        rows.append(r[alone])
        keys.append(w[alone])
        places.append(before[alone])
        by = by[used[by] & ~rare[by]]
        group, r, w, before = group[by], r[by], w[by], before[by]
        first, lag = np.arange(len(by)), 1
        while len(first):
            first = first[first + lag < len(by)]
            first = first[group[first] == group[first + lag]]
            rows.append(r[first])
            keys.append((w[first] ^ (w[first + lag] * MIX)) * MIX)
            places.append(before[first + lag])
            lag += 1
    r, key, pos = np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(places)
    order = np.lexsort((pos, key, r))
    r, key, pos = r[order], key[order], pos[order]
    once = np.ones(len(r), bool)
    once[1:] = (r[1:] != r[:-1]) | (key[1:] != key[:-1])
    return r[once], key[once], pos[once]


def prefix_index(sets: DataFrame, threshold: float) -> DataFrame:
    """(g, k, n, word, pos): keys of the rarest words of each set, enough that two similar sets share at least one (``_keys``).

    Words are hashes, and ``word`` is that of a rare word or of two others: single words that many sets have would let
    candidates grow with the square of the texts. Equal hashes of different words only add candidates, which full sets decide. Rarity is read from a table
    of counters that goes to every task, so no word is shuffled to be counted; any order of words that all sets share is right.
    Words that occur once meet nothing and are left out; a set without other words has one row with a null word.
    """
    hashed = sets.select("g", "k", "n", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("hashes"))
    cells = hashed.select(F.explode("hashes").alias("h")).groupBy(F.pmod("h", F.lit(CELLS)).alias("cell")).agg(F.count("*").alias("df"))
    counted = cells.filter("df > 1").toArrow()
    table = np.ones(CELLS, np.int64)
    table[counted["cell"].to_numpy()] = counted["df"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)
    schema = StructType([*sets.select("g", "k", "n").schema, StructField("word", LongType()), StructField("pos", IntegerType())])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = shared.value
        for batch, n, h in _pieces(batches):
            row = np.repeat(np.arange(len(n)), n)
            seen = df[h % CELLS]
            order = np.lexsort((h, seen, row))
            take, words, at = _keys(h[order], seen[order], n, threshold)
            alone = np.setdiff1d(np.arange(len(n)), take)
            none = np.arange(len(take) + len(alone)) >= len(take)
            index = pa.array(np.concatenate([take, alone]))
            words, at = (np.concatenate([x, np.zeros(len(alone), np.int64)]) for x in (words, at))
            columns = [batch[c].take(index) for c in ("g", "k", "n")] + [pa.array(words, mask=none), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "k", "n", "word", "pos"])

    return hashed.mapInArrow(rarest, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their n, their hashes) with about ``TOKENS`` hashes at a time."""
    for batch in batches:
        ends = np.cumsum(batch["n"].to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + TOKENS, "right")))
            piece = batch.slice(start, stop - start)
            yield piece, np.diff(np.r_[done, ends[start:stop]]), piece["hashes"].flatten().to_numpy(zero_copy_only=False)
            start = stop


def signatures(sets: DataFrame) -> DataFrame:
    """(g, k, n, bits): a bit per word or more, each the parity of the words that fall on it, as longs of a power of two.

    Two sets differ in as many words at least as their bits do.
    """
    hashed = sets.select("g", "k", "n", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("hashes"))
    schema = StructType([*sets.select("g", "k", "n").schema, StructField("bits", ArrayType(LongType()))])

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, h in _pieces(batches):
            longs = 1 << np.ceil(np.log2(np.ceil(n / 64))).astype(np.int64)
            starts = np.cumsum(longs) - longs
            bit = h & np.repeat(longs * 64 - 1, n)
            flat = np.zeros(longs.sum(), np.uint64)
            np.bitwise_xor.at(flat, np.repeat(starts, n) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
            bits = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(flat)], pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("g", "k", "n")), bits], names=["g", "k", "n", "bits"])

    return hashed.mapInArrow(parities, schema)


def _common(threshold: float) -> Column:
    """The words that sets of ``n`` and ``_n`` share at least if they are similar."""
    return F.ceil((F.col("n") + F.col("_n")) * (threshold / (1 + threshold)) - 1e-9)


def _candidates(first: DataFrame, second: DataFrame, threshold: float) -> DataFrame:
    """(g, k, first): pairs that share a key and can still reach the threshold by size and by what each of them may miss."""
    a = first.select("g", "word", F.col("k").alias("first"), F.col("n").alias("_n"), F.col("pos").alias("_pos"))
    fits = (F.col("pos") <= F.col("n") - _common(threshold)) & (F.col("_pos") <= F.col("_n") - _common(threshold))
    return second.join(a, ["g", "word"]).filter((F.col("first") < F.col("k")) & fits).select("g", "k", "first").distinct()


def _apart() -> Column:
    """How many bits of ``bits`` and ``_bits`` differ, the longer one folded; 0 if it is more than twice as long."""
    a, b, xor = F.col("bits"), F.col("_bits"), lambda x, y: x.bitwiseXOR(y)
    least = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) > least, F.zip_with(F.slice(x, F.lit(1), least), F.slice(x, least + 1, least), xor)).otherwise(x)

    ones = F.transform(F.zip_with(folded(a), folded(b), xor), lambda x: F.bit_count(x))
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * least, F.aggregate(ones, F.lit(0), lambda s, x: s + x)).otherwise(0)


def _similar(pairs: DataFrame, sets: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets are similar; signatures decide first, then only sets of pairs that are left are moved."""
    other = bits.select("g", F.col("k").alias("first"), F.col("n").alias("_n"), F.col("bits").alias("_bits"))
    near = _stored(pairs).join(bits, ["g", "k"]).join(other, ["g", "first"])
    near = near.filter(_apart() <= F.col("n") + F.col("_n") - 2 * _common(threshold))
    pairs = _stored(near.select("g", "k", "first").distinct())
    met = pairs.select("g", "k").unionByName(pairs.select("g", F.col("first").alias("k"))).distinct()
    sets = sets.join(met, ["g", "k"], "left_semi").select("g", "k", "words")
    other = sets.select("g", F.col("k").alias("first"), F.col("words").alias("_words"))
    return (
        pairs.join(sets, ["g", "k"])
        .join(other, ["g", "first"])
        .filter(jaccard(F.split("words", " "), F.split("_words", " ")) >= threshold)
        .select("g", "k", "first")
    )


def _settle(edges: DataFrame, waiting: DataFrame) -> DataFrame:
    """(g, k, kept) for all texts the edges decide; ``waiting`` is (g, k, ready).

    A ready text without an earlier similar text that is kept or undecided is kept; a text with a kept earlier similar
    text is dropped. Repeats until nothing changes; a round is a few joins over the similar pairs only.
    """
    touched = edges.select("g", "k").distinct()
    free = waiting.filter("ready").join(touched, ["g", "k"], "left_anti").select("g", "k", F.lit(True).alias("kept"))
    decided = cut_lineage(free)
    open_edges = edges
    while True:
        state = decided.select("g", F.col("k").alias("first"), "kept")
        seen = open_edges.join(state, ["g", "first"], "left")
        verdict = seen.groupBy("g", "k").agg(
            F.coalesce(F.bool_or("kept"), F.lit(False)).alias("hit"),
            F.count_if(F.col("kept").isNull()).alias("pending"),
        )
        new = (
            verdict.join(waiting, ["g", "k"])
            .filter(F.col("hit") | (F.col("ready") & (F.col("pending") == 0)))
            .select("g", "k", (~F.col("hit")).alias("kept"))
        )
        new = cut_lineage(new)
        if new.isEmpty():
            return decided
        decided = decided.unionByName(new)
        open_edges = open_edges.join(new.select("g", "k"), ["g", "k"], "left_anti")


def keep_first_similar(
    df: DataFrame,
    group: str,
    key: str,
    text: str,
    threshold: float = fixed.DUPLICATE_THRESHOLD,
    min_chars: int = fixed.DUPLICATE_MIN_CHARS,
    front: int = FRONT,
) -> DataFrame:
    """(group, key) of the kept texts: exact greedy result in the order of ``key`` inside each group.

    Texts below ``min_chars`` go, but for the only text of a group, which stays whatever it is.
    Equal word sets collapse to their first text. The rest is indexed under keys of its rarest words, of which only those stay that
    two texts have. Each round compares the
    first ``front`` texts of every key, decides those whose earlier candidates are all in view, and compares the
    newly kept ones with the texts further down. A key shared by many near copies therefore costs one comparison per
    text and kept text, never all pairs, and no candidate is left out. Texts without a group or key are similar to nothing; without a
    group only the only text stays.
    """
    sets = _stored(word_sets(df, group, key, text, min_chars).filter("g IS NOT NULL"))
    worded = sets.filter("n > 0 AND k IS NOT NULL")
    bits = _stored(signatures(worded))
    by = Window.partitionBy("g", "word").orderBy("k")
    index = prefix_index(worded, threshold).filter("word IS NOT NULL")
    index = index.select("*", F.row_number().over(by).alias("_rank"), F.lead("k").over(by).alias("_next"))
    ranked = _stored(index.filter("_rank > 1 OR _next IS NOT NULL").drop("_next"))
    kept = sets.select("g", "k").join(ranked.select("g", "k").distinct(), ["g", "k"], "left_anti")
    while not ranked.isEmpty():
        head = ranked.filter(F.col("_rank") <= front)
        edges = cut_lineage(_similar(_candidates(head, head, threshold), sets, bits, threshold))
        waiting = cut_lineage(
            ranked.groupBy("g", "k")
            .agg(F.count("*").alias("_n"), F.count_if(F.col("_rank") <= front).alias("_h"))
            .filter("_h > 0")
            .select("g", "k", (F.col("_n") == F.col("_h")).alias("ready"))
        )
        decided = cut_lineage(_settle(edges, waiting))
        new = decided.filter("kept").select("g", "k")
        kept = kept.unionByName(new)
        rest = _stored(ranked.drop("_rank").join(decided.select("g", "k"), ["g", "k"], "left_anti"))
        if rest.isEmpty():
            break
        pivots = ranked.join(new, ["g", "k"], "left_semi")
        close = _similar(_candidates(pivots, rest, threshold), sets, bits, threshold).select("g", "k").distinct()
        ranked = _stored(rest.join(close, ["g", "k"], "left_anti").withColumn("_rank", F.row_number().over(by)))
    only = df.groupBy(group).agg(F.count("*").alias("_n"), F.min(key).alias(key)).filter("_n = 1").select(group, key)
    return kept.select(F.col("g").alias(group), F.col("k").alias(key)).unionByName(only).distinct()
