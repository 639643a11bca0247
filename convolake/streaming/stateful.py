"""Keyed state that built-in aggregates cannot express: balances with refills, growing texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convolake.functions.chunks import last_separator
from convolake.streaming.runner import run_append, run_folded


def spend(credits: float, last, rows: pd.DataFrame, amount: float, every: pd.Timedelta):
    """Fold of spend rows in time order: refill first when the spend would exhaust the credits, then clamp at zero."""
    out = []
    for ts, ident, cost in zip(rows["ts"], rows["id"], rows["cost"]):
        refill = credits - cost <= 0 and amount > 0 and (last is None or last + every <= ts)
        if refill:
            credits, last = credits + amount, ts
        credits = max(0.0, credits - cost)
        out.append((ident, credits, refill))
    return credits, last, out


def stream_balances(stream: DataFrame, opening: float, amount: float, every_days: int) -> DataFrame:
    """(user, id, balance, refilled) for a stream of (user, ts, id, cost).

    State per user: credits and time of the last refill. The rows of one key in a micro-batch are bounded by the
    trigger size of the source.
    """
    every = pd.Timedelta(days=every_days)

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        credits, last = state.get if state.exists else (opening, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        credits, last, out = spend(credits, None if last is None else pd.Timestamp(last, unit="us"), rows, amount, every)
        state.update((credits, None if last is None else last.value // 1000))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["user", "id", "balance", "refilled"])

    balances = stream.groupBy("user").applyInPandasWithState(
        update,
        "user bigint, id bigint, balance double, refilled boolean",
        "credits double, last bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return run_append(balances, "balances")


# Unchanged polls after which a text is given up, and the least growth worth a chunk.
MAX_UNCHANGED, MIN_GROWTH = 10, 20


def grow(sent: int, unchanged: int, text: str, complete: bool):
    """(sent, unchanged, chunk or None, finished) after one look at a growing text."""
    if unchanged >= MAX_UNCHANGED:
        return sent, unchanged, None, False
    rest = text[sent:]
    if not rest:
        unchanged += 1
    if complete:
        return (len(text), unchanged, rest.strip(), True) if rest.strip() else (sent, unchanged, None, True)
    if len(rest) >= MIN_GROWTH:
        mark = last_separator(rest)
        chunk = rest[: mark + 1] if mark >= 0 else rest
        return sent + len(chunk), unchanged, chunk, False
    return sent, unchanged, None, False


def next_grown(state: tuple[int, int], row: tuple[int, str, bool]) -> tuple[tuple, tuple | None]:
    """(sent, unchanged) after one look (seq, text, complete), and (seq, chunk, finished) if it gave a chunk."""
    seq, text, complete = row
    sent, unchanged, chunk, finished = grow(*state, text, complete)
    return (sent, unchanged), (seq, chunk, finished) if chunk else None


def stream_growing_texts(stream: DataFrame) -> DataFrame:
    """(key, seq, chunk, finished) for a stream of looks (key, seq, text, complete) at growing texts."""
    rows = stream.select("key", "seq", "text", "complete")
    return run_folded(rows, ["seq"], next_grown, (0, 0), "sent int, unchanged int", "key string, seq int, chunk string, finished boolean", "growing-texts")
