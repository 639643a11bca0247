"""Splitting whole texts into chunks."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions import fixed
from convolake.functions.text import let, sentences, token_estimate, trim_space


def chunks(text: Column, size: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Sentences packed up to ``size`` estimated tokens; a new chunk opens with the tail of the one before.

    The tail is the fewest closing words worth ``overlap`` tokens. A sentence above the size is cut by words, each of
    which is worth two tokens, and closes the chunk before it.
    """
    tail_words = next(k for k in range(1, overlap + 2) if math.ceil(k * 1.3) >= overlap)
    per_piece = size // 2
    state = lambda done, cur, tokens: F.struct(
        done.alias("done"), cur.alias("cur"), tokens.cast("bigint").alias("tokens")
    )
    nothing = F.array().cast("array<string>")

    def tail(cur: Column) -> Column:
        return F.when(token_estimate(cur) <= overlap, cur).otherwise(
            let(F.split(cur, " "), lambda w: F.array_join(F.slice(w, -F.least(F.size(w), F.lit(tail_words)), tail_words), " "))
        )

    def pieces(sentence: Column) -> Column:
        return let(
            F.split(sentence, " "),
            lambda w: F.transform(
                F.sequence(F.lit(0), F.floor((F.size(w) - 1) / per_piece).cast("int")),
                lambda i: trim_space(F.array_join(F.slice(w, i * per_piece + 1, per_piece), " ")),
            ),
        )

    def step(acc: Column, s: Column) -> Column:
        n = token_estimate(s)
        closed = F.concat(acc["done"], F.when(acc["cur"] != "", F.array(trim_space(acc["cur"]))).otherwise(nothing))
        opened = F.concat(tail(acc["cur"]), F.lit(" "), s)
        return (
            F.when(n > size, state(F.concat(closed, pieces(s)), F.lit(""), F.lit(0)))
            .when(acc["tokens"] + n > size, let(opened, lambda o: state(closed, o, token_estimate(o))))
            .otherwise(
                state(
                    acc["done"],
                    F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(" "), s)).otherwise(s),
                    acc["tokens"] + n,
                )
            )
        )

    return F.aggregate(
        sentences(text),
        state(nothing, F.lit(""), F.lit(0)),
        step,
        lambda acc: F.filter(
            F.concat(acc["done"], F.when(acc["cur"] != "", F.array(trim_space(acc["cur"]))).otherwise(nothing)),
            lambda c: c != "",
        ),
    )


# Places where spoken text may be cut.
SEPARATORS = [".", "?", "!", "۔", "。", "‥", ";", "¡", "¿", "\n", "```"]


def last_separator(text: str) -> int:
    return max(text.rfind(s) for s in SEPARATORS)


def cut_text(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` characters cut behind their last separator; without one, up to the next word."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            mark = last_separator(text[at:end])
            if mark >= 0:
                end = at + mark + 1
            else:
                gap = re.search(r"\S", text[end:])
                end += gap.start() if gap else 0
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def with_cut_text(df: DataFrame, key: str, text: str, size: int = 4000) -> DataFrame:
    """(key, part, text) rows of every text cut at separators."""

    def run(batches):
        for pdf in batches:
            rows = [(k, i, p) for k, t in zip(pdf[key], pdf[text]) for i, p in enumerate(cut_text(t or "", size))]
            yield pd.DataFrame(rows, columns=[key, "part", text])

    return df.select(F.col(key).cast("bigint"), text).mapInPandas(run, f"{key} bigint, part int, {text} string")
