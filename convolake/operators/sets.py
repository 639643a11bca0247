"""Set algebra on array columns and on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_changes(old: Column, new: Column) -> tuple[Column, Column]:
    """(added, removed) elements."""
    return F.array_except(new, old), F.array_except(old, new)


def add_to_set(items: Column, more: Column) -> Column:
    return F.array_union(items, more)


def pull(items: Column, value: Column) -> Column:
    return F.filter(items, lambda x: x != value)


def rename_element(items: Column, old: Column, new: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda x: F.when(x == old, new).otherwise(x)))


def same_members(a: Column, b: Column) -> Column:
    """Equal as bags, whatever the order; elements may be structs."""
    canon = lambda c: F.array_sort(F.transform(c, lambda x: F.to_json(F.struct(x.alias("v")))))
    return canon(a) == canon(b)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key; combines before the shuffle."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def union_missing(given: DataFrame, wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Given rows plus stored rows of wanted keys that are not given yet; repeats removed."""
    missing = wanted.select(key).distinct().join(given.select(key), key, "left_anti")
    return given.dropDuplicates([key]).unionByName(stored.join(missing, key, "left_semi"))
