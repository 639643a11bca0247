"""Token counts that a caller can swap: an expression of the JVM, or a Python function that sees Arrow batches of texts."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from convolake.functions.text import token_estimate

Counts = Callable[[list[str]], list[int]]


@dataclass(frozen=True)
class Tokenizer:
    """``count`` gives the tokens of a text column, ``total`` those of an array of texts; null gives null.

    ``load`` is called inside a task and gives the function that Python operators (the chunker) count with.
    """

    count: Callable[[Column], Column]
    total: Callable[[Column], Column]
    load: Callable[[], Counts]


def estimate(texts: list[str]) -> list[int]:
    return [math.ceil(len(t.split(" ")) * 1.3) for t in texts]


ESTIMATE = Tokenizer(
    token_estimate,
    lambda texts: F.aggregate(texts, F.lit(0).cast("bigint"), lambda acc, t: acc + F.coalesce(token_estimate(t), F.lit(0))),
    lambda: estimate,
)


def arrow_tokenizer(load: Callable[[], Counts]) -> Tokenizer:
    """A tokenizer from a Python function; ``load`` (a vocabulary, say) runs once per task, not per batch."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = load()
        for texts in batches:
            found = iter(counts([t for t in texts if t is not None]))
            yield pd.Series([None if t is None else next(found) for t in texts], dtype="Int64")

    @F.pandas_udf(LongType())
    def total(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = load()
        for lists in batches:
            found = iter(counts([t for x in lists if x is not None for t in x if t is not None]))
            yield pd.Series([None if x is None else sum(next(found) for t in x if t is not None) for x in lists], dtype="Int64")

    return Tokenizer(count, total, load)


@functools.cache
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class PieceCounts:
    """Counts by the pieces that the pattern parts a text into; the counts of pieces are kept, as most pieces come again."""

    KEPT, KEPT_TEXTS = 200_000, 1_000

    def __init__(self, encoding, pattern: str):
        import regex

        self.encoding, self.pattern = encoding, regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.last: dict[str, int] = {}

    def piece(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            n = len(self.encoding.encode_ordinary(text))
            if len(text) < 64:
                if len(self.known) >= self.KEPT:
                    self.known.clear()
                self.known[text] = n
        return n

    def __call__(self, texts: list[str]) -> list[int]:
        return [self.whole(t) for t in texts]

    def whole(self, text: str) -> int:
        """A chunk is counted where it is closed and again as a result, so the last texts are kept."""
        n = self.last.get(text)
        if n is None:
            n = len(self.encoding.encode_ordinary(text))
            if len(self.last) >= self.KEPT_TEXTS:
                self.last.clear()
            self.last[text] = n
        return n

    def ends(self, text: str, starts: list[int]) -> Iterator[int]:
        """The counts of ``text[s:]`` for falling ``starts``: matching goes on as in an earlier one once it meets a place of it."""
        worth = {len(text): 0}
        for start in starts:
            path, at = [], start
            while at not in worth:
                match = self.pattern.match(text, at)
                path.append((at, self.piece(match.group())))
                at = match.end()
            total = worth[at]
            for at, n in reversed(path):
                total += n
                worth[at] = total
            yield total


def byte_pairs(path: str, pattern: str) -> Tokenizer:
    """Counts of a byte-pair vocabulary: a file of base64 tokens and ranks, and the pattern that parts a text.

    The pattern must match at every place and look at nothing before it.
    """

    return arrow_tokenizer(lambda: PieceCounts(_encoding(path, pattern), pattern))
