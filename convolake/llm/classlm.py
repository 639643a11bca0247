"""Class-based n-gram scores: words grouped by exchange clustering, class transitions and word emissions.

All training texts are counted. The most frequent words are clustered first, from the matrix of their bigrams. Then every
other word that occurs twice or more is put into the class that the likelihood of the class bigrams gains most from:
words with a share of at least one in ``vocabulary`` tokens (hence no more than that many) in rounds over a table of
their neighbours, split by word, where half of them move at a time; rarer ones once, by a join-free grouping of the classes
before them. Words seen once stand for the unknown ones. A word's class depends on the class of the word before it; all
words below the share are alike as such a context. The number of classes grows with the sixth root of the tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import id_and_text, met, slices, text_key, written

CORE_WORDS = 1000  # clustered before the others
VOCABULARY = 1_000_000  # a word with this share of the tokens, or a larger one, is known to every task
SWEEPS = 8  # over the most frequent words
HALF_SWEEPS = 4  # over the other words known to every task
BACKOFF = 8.0  # weight of a class's overall share in its transition probabilities
FLUSH = 400_000  # distinct words a task counts before it hands on its counts
RARE_FLUSH = 80_000  # (rare word, class before it) a task counts: few occur twice there
TOKENS = 1_000_000  # tokens whose neighbours are gathered at a time, and per shard of words
NEIGHBOUR_BITS = 21  # of a code that tells word, side and neighbour
FEW = 8  # gains of counts up to this are looked up


def classes_for(tokens: int) -> int:
    return max(1, round(4 * tokens ** (1 / 6)))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) of all words of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["0", "1"])

        for _, texts in slices(batches):
            for t in texts:
                counts.update(t.encode().lower().split())
            if len(counts) > FLUSH:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return id_and_text(train).mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def encoded(rows: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, key, learn, scored, symbols (packed int32: 1 and up in the order of ``words``, one more for the rest), rare (the rest, in order)."""
    shared = rows.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(words, 1)})
    rest = len(words) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for ids, keys, learn, scored, texts in slices(batches):
            symbols, rare = [], []
            for t in texts:
                parts = t.encode().lower().split()
                s = [get(w, rest) for w in parts]
                symbols.append(np.array(s, np.int32).tobytes())
                rare.append([w.decode() for w, i in zip(parts, s, strict=True) if i == rest])
            columns = ((ids, pa.int64()), (keys, pa.int64()), (learn, pa.bool_()), (scored, pa.bool_()), (symbols, pa.binary()), (rare, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=[str(i) for i in range(6)])

    text = F.coalesce("text", F.lit(""))
    keyed = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(text).alias("key"), "learn", "scored", text.alias("text"))
    return keyed.mapInArrow(run, "doc_id bigint, key bigint, learn boolean, scored boolean, symbols binary, rare array<string>")


def _sequences(batches: Iterator[pa.RecordBatch], tokens: int = TOKENS) -> Iterator[np.ndarray]:
    """Symbols of whole texts, many at a time, with an end (0) before, between and behind them."""
    held, n = [b"\0\0\0\0"], 0
    for batch in batches:
        for value in batch.column(0):
            data = value.as_buffer()
            held += [data, b"\0\0\0\0"]
            n += len(data) // 4 + 1
            if n >= tokens:
                yield np.frombuffer(b"".join(held), np.int32)
                held, n = [b"\0\0\0\0"], 0
    if n:
        yield np.frombuffer(b"".join(held), np.int32)


def pair_counts(train: DataFrame, number: np.ndarray, size: int) -> np.ndarray:
    """How often a group follows another in the encoded texts; ``number`` tells the group of each symbol, below ``size``."""
    shared = train.sparkSession.sparkContext.broadcast(number.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, np.zeros(size * size, np.int64)
        for s in _sequences(batches, TOKENS // 2):
            g = own[s].astype(np.int64)
            code = g[:-1] * size + g[1:]
            if len(code) * 8 > len(total):
                total += np.bincount(code, minlength=len(total))
            else:
                at, times = np.unique(code, return_counts=True)
                total[at] += times
        for a in range(size):  # a row per group
            b = np.flatnonzero(total[a * size : (a + 1) * size]) + a * size
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(total[b], pa.int64())], names=["0", "1"])

    table = train.select("symbols").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most size ** 2
    matrix = np.zeros(size * size)
    matrix[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return matrix.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(matrix: np.ndarray, core: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol. Core words (symbols 1 to ``core``) are exchanged; every other symbol keeps a class of its own."""
    n = len(matrix)
    group = np.empty(n, np.int64)
    group[1 : core + 1] = np.arange(core) % max(1, min(classes, core))
    fixed = [0, *range(core + 1, n)]
    group[fixed] = classes + np.arange(len(fixed))
    m = classes + len(fixed)
    counts = matrix.astype(float)
    f = _f
    onehot = np.zeros((n, m))
    onehot[np.arange(n), group] = 1
    pairs = onehot.T @ counts @ onehot
    right, left = counts @ onehot, counts.T @ onehot  # of each word: followers, predecessors by class
    for _ in range(sweeps):
        moved = 0
        for w in range(1, core + 1):
            r, q, loop, old = right[w], left[w], counts[w, w], group[w]
            if r.sum() + q.sum() == 0:
                continue
            # Without the word.
            r0, q0 = r.copy(), q.copy()
            r0[old] -= loop
            q0[old] -= loop
            base = pairs.copy()
            base[old, :] -= r0
            base[:, old] -= q0
            base[old, old] -= loop
            rows, cols = base[:classes], base[:, :classes].T
            gain = (f(rows + r0) - f(rows)).sum(1) + (f(cols + q0) - f(cols)).sum(1)
            own = np.arange(classes)
            diagonal = base[own, own]
            gain += f(diagonal + r0[own] + q0[own] + loop) - f(diagonal + r0[own]) - f(diagonal + q0[own]) + f(diagonal)
            out, into = base.sum(1)[:classes], base.sum(0)[:classes]
            gain -= f(out + r.sum()) - f(out) + f(into + q.sum()) - f(into)
            new = int(gain.argmax())
            if new != old and gain[new] > gain[old] + 1e-9:
                moved += 1
                group[w] = new
                right[:, old] -= counts[:, w]
                right[:, new] += counts[:, w]
                left[:, old] -= counts[w]
                left[:, new] += counts[w]
            pairs = base
            pairs[new, :] += r0
            pairs[:, new] += q0
            pairs[new, new] += loop
        if not moved:
            break
    return group


def neighbours(train: DataFrame, first: int, last: int, tokens: int) -> DataFrame:
    """(shard, codes, times): for symbols from ``first`` to ``last`` how often each neighbour stands before (side 0) or behind (1).

    A code is symbol, side and neighbour in one number; codes of a shard are sorted. Symbols are ordered by frequency and
    dealt over the shards; the first ones, which could make a shard large, are not among them.
    """
    shards = max(1, -(-tokens // TOKENS))
    mask = np.int64(1 << (NEIGHBOUR_BITS + 1))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _sequences(batches):
            s = s.astype(np.int64)
            parts = []
            for side, (word, other) in enumerate(((s[1:], s[:-1]), (s[:-1], s[1:]))):
                at = (word >= first) & (word <= last)
                parts.append((word[at] * 2 + side) << NEIGHBOUR_BITS | other[at])
            codes, times = np.unique(np.concatenate(parts), return_counts=True)
            shard = codes // mask % shards
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                at = order[bounds[k] : bounds[k + 1]]
                yield _packed(int(k), codes[at], times[at])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def settled() -> pa.RecordBatch:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return _packed(now, codes, np.bincount(at, weights=np.concatenate([t for _, t in held])))

        for batch in batches:
            for shard, codes, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if shard != now and held:
                    yield settled()
                    held.clear()
                now = shard
                held.append(_unpacked(codes, times))
        if held:
            yield settled()

    schema = "shard int, codes binary, times binary"
    dealt = train.select("symbols").mapInArrow(gather, schema).repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, schema)


def _packed(shard: int, codes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    steps = np.diff(codes, prepend=0).astype(np.int64)
    columns = [pa.array([shard], pa.int32()), pa.array([steps.tobytes()], pa.binary()), pa.array([times.astype(np.int64).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["0", "1", "2"])


def _unpacked(codes: pa.Scalar, times: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(codes.as_buffer(), np.int64)), np.frombuffer(times.as_buffer(), np.int64)


class Gains:
    """What the likelihood of class bigrams gains when a word with given neighbours joins a class, or loses when it leaves.

    The counts are those before the move; what a word adds to a class that is also its neighbour's is not followed up.
    """

    def __init__(self, pairs: np.ndarray, classes: int):
        self.classes = classes
        self.sides = (pairs[:, :classes], pairs[:classes].T)  # by class of the neighbour, then class of the word
        few = np.arange(FEW + 1)[:, None, None]
        self.join = [_f(x[None] + few) - _f(x)[None] for x in self.sides]
        self.sizes = (pairs.sum(0)[:classes], pairs.sum(1)[:classes])

    def best(self, word: np.ndarray, side: np.ndarray, near: np.ndarray, n: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, their best classes) from rows sorted by word; ``old`` is the class of each row's word or -1."""
        new = np.ones(len(word), bool)
        new[1:] = word[1:] != word[:-1]
        starts = np.flatnonzero(new)
        gain = np.zeros((len(starts), self.classes))
        ranks = np.cumsum(new) - 1
        own = old[starts]
        kept = np.flatnonzero(own >= 0)
        for s in (0, 1):
            rows = np.flatnonzero(side == s)
            for i in range(0, len(rows), 20_000):
                at = rows[i : i + 20_000]
                few = np.minimum(n[at], FEW)
                part = self.join[s][few, near[at]]
                many = np.flatnonzero(n[at] > FEW)
                x = self.sides[s][near[at[many]]]
                part[many] = _f(x + n[at[many], None]) - _f(x)
                left = np.flatnonzero(old[at] >= 0)
                x = self.sides[s][near[at[left]], old[at[left]]]
                part[left, old[at[left]]] = _f(x) - _f(np.maximum(x - n[at[left]], 0))
                begins = np.flatnonzero(np.diff(ranks[at], prepend=-1))
                np.add.at(gain, ranks[at[begins]], np.add.reduceat(part, begins, axis=0))
            total = np.bincount(ranks[rows], weights=n[rows], minlength=len(starts))
            size = self.sizes[s]
            cost = _f(size[None] + total[:, None]) - _f(size)[None]
            cost[kept, own[kept]] = _f(size[own[kept]]) - _f(np.maximum(size[own[kept]] - total[kept], 0))
            gain -= cost
        best = gain.argmax(1)
        stay = kept[gain[kept, best[kept]] <= gain[kept, own[kept]] + 1e-9]
        best[stay] = own[stay]
        return word[starts], best


def moved(table: DataFrame, group: np.ndarray, pairs: np.ndarray, classes: int, half: int | None) -> np.ndarray:
    """The groups after every word of the table, or every second one, has gone to its best class."""
    shared = table.sparkSession.sparkContext.broadcast((group.astype(np.int32), pairs))
    unclassed = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, p = shared.value
        gains = Gains(p, classes)
        for batch in batches:
            for codes, times in zip(batch.column(0), batch.column(1), strict=True):
                codes, times = _unpacked(codes, times)
                near = own[codes & ((1 << NEIGHBOUR_BITS) - 1)]
                word = codes >> (NEIGHBOUR_BITS + 1)
                # In the first round words without a class are counted with the rare ones, as in the pairs.
                near = np.where(near == unclassed, unclassed - 1, near)
                if half is not None:
                    at = word % 2 == half
                    codes, times, near, word = codes[at], times[at], near[at], word[at]
                if len(word):
                    key, at = np.unique((codes >> NEIGHBOUR_BITS) * unclassed + near, return_inverse=True)
                    n = np.bincount(at, weights=times).astype(np.int64)
                    who = key // unclassed // 2
                    old = np.where(own[who] < classes, own[who], -1)
                    words, best = gains.best(who, key // unclassed % 2, key % unclassed, n, old)
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(best, pa.int64())], names=["0", "1"])

    found = table.select("codes", "times").mapInArrow(run, "word bigint, class bigint").toArrow()  # no more than the words known to every task
    new = group.copy()
    new[found.column("word").to_numpy()] = found.column("class").to_numpy()
    return new


def classed(train: DataFrame, n_words: int, tokens: int, core: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, counts of class pairs): word classes, then the end, then the rest."""
    core = min(core, n_words)
    end, rest, size = classes, classes + 1, classes + 2
    number = np.minimum(np.arange(n_words + 2), core + 1)
    top = exchange(pair_counts(train, number, core + 2), core, classes)
    group = np.full(n_words + 2, size, np.int64)
    group[1 : core + 1] = top[1 : core + 1]
    group[0], group[-1] = end, rest

    def pairs() -> np.ndarray:
        return pair_counts(train, np.minimum(group, rest), size)

    if n_words > core:
        table = written(neighbours(train, core + 1, n_words, tokens), "neighbours")
        group = moved(table, group, pairs(), classes, None)
        for i in range(HALF_SWEEPS):
            group = moved(table, group, pairs(), classes, i % 2)
    return group, pairs()


def rare_classes(texts: DataFrame, group: np.ndarray, pairs: np.ndarray, classes: int) -> DataFrame:
    """(word, c, class, crowd, near, n): class of each word that no task knows, and how often each class stands before it.

    ``c`` and ``n`` count texts to learn from, ``crowd`` those to score. A word seen at most once is in the class
    ``classes + 1``, that of unknown words.
    """
    shared = texts.sparkSession.sparkContext.broadcast((group.astype(np.int32), pairs))
    rest = len(group) - 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = shared.value
        learned: Counter = Counter()
        met_by: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(learned.keys() | met_by.keys())
            columns = [pa.array([w for w, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32())]
            columns += [pa.array([c[k] for k in keys], pa.int64()) for c in (learned, met_by)]
            return pa.RecordBatch.from_arrays(columns, names=["0", "1", "2", "3"])

        for learn, scored, symbols, rare in slices(batches):
            for to_learn, to_score, s, words in zip(learn, scored, symbols, rare, strict=True):
                found = list(zip(words, before(np.frombuffer(s, np.int32), own, rest), strict=True))
                if to_learn:
                    learned.update(found)
                if to_score:
                    met_by.update(found)
            if len(learned) + len(met_by) > RARE_FLUSH:
                yield flush()
                learned.clear()
                met_by.clear()
        if learned or met_by:
            yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(shared.value[1], classes)
        # The class that all rare words shared is only their context: no class of a word loses anything.
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(1).to_numpy()
            lists, times = batch.column(3), batch.column(4)
            size = lists.value_lengths().to_numpy()
            word = np.repeat(np.arange(batch.num_rows), size)
            near, n = lists.flatten().to_numpy(), times.flatten().to_numpy()
            none = np.full(len(word), -1)
            _, best = gains.best(word, np.zeros(len(word), np.int64), near, n, none)
            best[c <= 1] = classes + 1
            columns = [batch.column(0), batch.column(1), pa.array(best, pa.int32()), batch.column(2), lists, times]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(6)])

    seen = texts.select("learn", "scored", "symbols", "rare").filter(F.size("rare") > 0).mapInArrow(gather, "word string, near int, n bigint, crowd bigint")
    by_class = seen.repartition("word").groupBy("word", "near").agg(F.sum("n").alias("n"), F.sum("crowd").alias("crowd"))
    lists = F.collect_list(F.struct("near", "n")).alias("l")  # an entry per class at most
    by_word = by_class.groupBy("word").agg(F.sum("n").alias("c"), F.sum("crowd").alias("crowd"), lists)
    by_word = by_word.select("word", "c", "crowd", F.col("l.near").alias("near"), F.col("l.n").alias("n"))
    return by_word.mapInArrow(choose, "word string, c bigint, class int, crowd bigint, near array<int>, n array<bigint>")


def before(symbols: np.ndarray, group: np.ndarray, rest: int) -> list[int]:
    """Class of what stands before each rare word of a text."""
    at = np.flatnonzero(symbols == rest)
    return group[np.where(at > 0, symbols[at - 1], 0)].tolist()


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def scores(docs: DataFrame, train: DataFrame | Column, core: int = CORE_WORDS, classes: int | None = None, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row of ``docs``.

    ``train`` holds the texts to learn from, or tells which rows of ``docs`` they are (null: not). The ``core`` most
    frequent words are clustered first; words with a share of 1 / ``vocabulary`` of the tokens or more are known to every task.

    A null or empty text is its end alone; a null doc_id stays null; repeated rows are scored alike; without training
    texts every word is unknown; an empty table gives an empty result.
    """
    if not 0 < vocabulary < 1 << (NEIGHBOUR_BITS - 1):
        raise ValueError(f"vocabulary must be below {1 << (NEIGHBOUR_BITS - 1)}")
    yes, no = F.lit(True), F.lit(False)
    if isinstance(train, Column):
        rows = docs.select("doc_id", "text", F.coalesce(train, no).alias("learn"), yes.alias("scored"))
    else:
        rows = docs.select("doc_id", "text", no.alias("learn"), yes.alias("scored"))
        rows = rows.unionByName(train.select("doc_id", "text", yes.alias("learn"), no.alias("scored")))
    counts = written(word_counts(rows.filter("learn")), "word-counts")
    ends = rows.filter("learn").count()
    n_words, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = (n_words or 0) + ends, distinct + (ends > 0)
    known = counts.filter((F.col("c") >= 2) & (F.col("c") * vocabulary >= n)).toArrow()  # at most ``vocabulary`` words
    order = sorted(zip((-known.column("c").to_numpy()).tolist(), known.column("word").to_pylist(), strict=True))
    words = [w for _, w in order]
    count_of = np.array([ends, *[-c for c, _ in order], 0], float)

    texts = written(encoded(rows, words), "encoded")
    classes = classes or classes_for(n)
    group, pairs = classed(texts.filter("learn"), len(words), n, core, classes)
    rare = written(rare_classes(texts, group, pairs, classes), "rare-words")
    unknown = classes + 1
    moves = pairs.copy()
    moves[:, unknown] = 0
    rare_moves = rare.select("class", F.explode(F.arrays_zip("near", "n")).alias("p")).groupBy("class", "p.near").agg(F.sum("p.n").alias("n"))
    for r in rare_moves.collect():  # at most a number per pair of classes
        moves[r["near"], r["class"]] += r["n"]
    size = moves.sum(0)
    share = (size + 0.5) / (size.sum() + 0.5 * len(size))
    transition = np.log10((moves + BACKOFF * share) / (moves.sum(1, keepdims=True) + BACKOFF))
    log_size = np.log10(np.maximum(size, 1))
    log_size[unknown] = math.log10(size[unknown] + 0.5 * (size[unknown] + 1))
    floor = math.log10(n + 0.5 * (v + 1))
    base_of = np.log10(count_of + 0.5) - floor
    own_of = np.log10(np.maximum(count_of, 1)) - log_size[group]
    own_of[0] = 0.0  # the end is alone in its class
    model = docs.sparkSession.sparkContext.broadcast((group.astype(np.int32), transition, own_of, base_of))
    rest = len(words) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, transition, own_of, base_of = model.value
        for ids, symbols, rare in slices(batches):
            out = []
            for data, names in zip(symbols, rare, strict=True):
                s = np.concatenate([[0], np.frombuffer(data, np.int32), [0]])
                at = np.flatnonzero(s[1:] != rest) + 1
                own = transition[group[s[at - 1]], group[s[at]]].sum() + own_of[s[at]].sum()
                left = Counter(zip(names, before(s[1:-1], group, rest), strict=True))
                out.append((len(s) - 1, len(at) - (ends == 0), float(base_of[s[at]].sum()), float(own), [w for w, _ in left], [k for _, k in left], list(left.values())))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            columns = [pa.array(ids, pa.int64()), *(pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(8)])

    schema = "doc_id bigint, n_tokens bigint, held bigint, base double, own double, word array<string>, near array<int>, times array<bigint>"
    partial = texts.filter("scored").select("doc_id", "symbols", "rare").mapInArrow(run, schema)
    partial = written(partial.withColumn("row", F.monotonically_increasing_id()), "partial-scores")
    # Words that no task knows meet their counts and classes by a join.
    met_rows = partial.select("row", F.explode(F.arrays_zip("word", "near", "times")).alias("r")).select("row", "r.*")
    met_rows = met(met_rows, rare.select("word", "c", "class", "crowd"), ["word"], "crowd")
    steps = [(i, k, float(transition[i, k] - log_size[k])) for i in range(len(transition)) for k in range(len(transition))]
    steps = docs.sparkSession.createDataFrame(steps, "near int, class int, step double")  # a row per pair of classes
    emitted = F.log10(F.when(F.col("class") == unknown, F.col("c") + 0.5).otherwise(F.col("c")))
    sums = (
        met_rows.join(F.broadcast(steps), ["near", "class"])
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - floor)).alias("rare_base"),
            F.sum(F.col("times") * (F.col("step") + emitted)).alias("rare_own"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    zero = F.lit(0.0)
    return partial.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("held") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("rare_own", zero)).alias("score"),
    )
