"""Row filters, as predicate builders (Column out) and small frame operators."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def all_equal(**values) -> Column:
    """Conjunction of equalities; a None value asks for null."""
    tests = [F.col(k).isNull() if v is None else F.col(k) == v for k, v in values.items()]
    return functools.reduce(operator.and_, tests)


def null_or_empty(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def any_contains(columns: list[str], needle: str) -> Column:
    """Case-insensitive literal substring in any column."""
    return functools.reduce(operator.or_, [F.lower(c).contains(needle.lower()) for c in columns])


def any_matches(columns: list[str], pattern: str) -> Column:
    """Case-insensitive regular expression in any column."""
    return functools.reduce(operator.or_, [F.col(c).rlike(f"(?i){pattern}") for c in columns])


def has_bits(column: str, bits: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(bits)) == bits


def live(expires: str) -> Column:
    """Rows without an expiry date."""
    return F.col(expires).isNull()


def visible_at(expires: str, now: Column) -> Column:
    return F.col(expires).isNull() | (F.col(expires) > now)


def flag_is(flag: Column, wanted: bool) -> Column:
    """Tri-state flag: a missing flag counts as false."""
    return F.coalesce(flag, F.lit(False)) == F.lit(wanted)


def valid_at(start: Column, end: Column, now: Column) -> Column:
    """Closed interval with an open end where ``end`` is null."""
    return (start <= now) & (end.isNull() | (end >= now))


def any_of(tests: list[Column]) -> Column:
    """Disjunction; false when there is nothing to test."""
    return functools.reduce(operator.or_, tests, F.lit(False))


def category_filter(wanted: str | None, category: str, author: Column, me) -> Column:
    """Listing category: a real one, or ``my`` / ``none`` / ``shared`` / unset."""
    if wanted is None:
        return F.lit(True)
    if wanted == "my":
        return author == me
    if wanted == "shared":
        return author != me
    if wanted == "none":
        return null_or_empty(category)
    return F.col(category) == wanted


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_bad) in one pass: a row counts for a rule unless the rule holds."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n_bad")
