"""Keyset and offset pages, ranked searches and date buckets."""

from __future__ import annotations

import base64
import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp_limit(limit, default: int = 20, low: int = 1, high: int = 100) -> int:
    """Page size between the bounds; the default stands in for anything that is no positive number."""
    try:
        value = int(limit)
    except (TypeError, ValueError):
        return default
    return max(low, min(high, value)) if value else default


def encode_cursor(values: dict) -> str:
    return base64.b64encode(json.dumps(values, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> dict:
    return json.loads(base64.b64decode(cursor))


def after_desc_asc(key: str, tie: str, key_value: Column, tie_value: Column) -> Column:
    """Rows behind (key, tie) in the order key descending, tie ascending."""
    return (F.col(key) < key_value) | ((F.col(key) == key_value) & (F.col(tie) > tie_value))


def keyset_page(df: DataFrame, key: str, tie: str, limit: int, after: tuple | None = None) -> DataFrame:
    """One page plus one row: key descending, tie ascending; ``after`` is the last row of the page before.

    The plan is a filter and a bounded top-n per partition, never a full sort.
    """
    if after is not None:
        kind, tie_kind = df.schema[key].dataType, df.schema[tie].dataType
        df = df.filter(after_desc_asc(key, tie, F.lit(after[0]).cast(kind), F.lit(after[1]).cast(tie_kind)))
    return df.orderBy(F.desc(key), F.asc(tie)).limit(limit + 1)


def page_with_cursor(page: DataFrame, key: str, tie: str, limit: int) -> DataFrame:
    """Rows of the page with ``has_more`` and the cursor behind each row (at most limit + 1 rows come in)."""
    rows = F.sort_array(
        F.collect_list(F.struct(F.col(key).alias("k"), (-F.col(tie)).alias("t"), F.struct(*page.columns).alias("r"))),
        asc=False,
    )
    cursor = F.base64(F.to_json(F.struct(F.col(key).cast("string").alias(key), F.col(tie).alias(tie))).cast("binary"))
    return (
        page.agg(rows.alias("rows"))
        .select(
            (F.size("rows") > limit).alias("has_more"),
            F.posexplode(F.slice("rows", 1, limit)).alias("position", "row"),
        )
        .select("position", "has_more", "row.r.*")
        .withColumn("cursor", cursor)
    )


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    page, size = max(1, page), max(1, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def relevance(columns: list[str], needle: str) -> Column:
    """Best of exact 100, prefix 80, contained 50, other 10 over the columns."""
    want = needle.lower()

    def one(c: str) -> Column:
        have = F.lower(F.coalesce(F.col(c), F.lit("")))
        return (
            F.when(have == want, 100)
            .when(have.startswith(want), 80)
            .when(have.contains(want), 50)
            .otherwise(10)
        )

    scores = [one(c) for c in columns]
    return functools.reduce(F.greatest, scores) if len(scores) > 1 else scores[0]


def date_bucket(ts: Column, now: Column) -> Column:
    """Struct (rank, label): Today, Yesterday, Previous 7 / 30 days, a month of this year, or a year."""
    day = F.date_trunc("day", now)
    back = lambda n: F.date_trunc("day", now - F.make_dt_interval(F.lit(n)))
    past = ts <= now
    label = (
        F.when(F.date_trunc("day", ts) == day, "Today")
        .when((ts >= back(1)) & past, "Yesterday")
        .when((ts >= back(7)) & past, "Previous 7 days")
        .when((ts >= back(30)) & past, "Previous 30 days")
        .when(F.year(ts) == F.year(now), F.date_format(ts, "MMMM"))
        .otherwise(F.concat(F.lit(" "), F.year(ts).cast("string")))
    )
    rank = (
        F.when(label == "Today", 0)
        .when(label == "Yesterday", 1)
        .when(label == "Previous 7 days", 2)
        .when(label == "Previous 30 days", 3)
        .when(F.year(ts) == F.year(now), 20 - F.month(ts))
        .otherwise(10000 - F.year(ts))
    )
    return F.struct(rank.alias("rank"), label.alias("label"))


