"""Look-ups and enrichments that go beyond one plain join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flagged(df: DataFrame, marks: DataFrame, on: str, flag: str) -> DataFrame:
    """Mark join: a boolean column telling whether the key occurs in ``marks``."""
    keys = marks.select(on).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, on, "left").withColumn(flag, F.col(flag).isNotNull())


def counted(dim: DataFrame, facts: DataFrame, on: str, name: str) -> DataFrame:
    """Every dimension row with its number of facts, zero included."""
    counts = facts.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias(name))
    return dim.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def enriched(hits: DataFrame, rows: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Stored columns added to hits; a value the hit carries itself wins."""
    stored = rows.select(on, *[F.col(c).alias(f"_s_{c}") for c in columns])
    own = set(hits.columns)
    merged = [
        (F.coalesce(F.col(c), F.col(f"_s_{c}")) if c in own else F.col(f"_s_{c}")).alias(c) for c in columns
    ]
    keep = [c for c in hits.columns if c not in columns]
    return hits.join(stored, on, "left").select(*keep, *merged)


def membership_diff(wanted: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to add and to remove so that ``current`` becomes ``wanted``: (keys, action)."""
    left = wanted.select(*keys).distinct().withColumn("_w", F.lit(True))
    right = current.select(*keys).distinct().withColumn("_c", F.lit(True))
    return (
        left.join(right, keys, "full_outer")
        .withColumn(
            "action", F.when(F.col("_c").isNull(), "added").when(F.col("_w").isNull(), "removed").otherwise("kept")
        )
        .select(*keys, "action")
    )


def best_role(rows: DataFrame, roles: DataFrame, bits: str) -> DataFrame:
    """Role whose bits equal the row's, else the largest role contained in them; null when none fits.

    ``roles`` is (resource_type, role, role_bits). Rows are first reduced to their distinct (type, bits).
    """
    asked = rows.select("resource_type", bits).distinct()
    fit = (
        asked.join(roles, "resource_type")
        .filter(F.col("role_bits").bitwiseAND(F.col(bits)) == F.col("role_bits"))
        .groupBy("resource_type", bits)
        .agg(F.max_by("role", F.struct(F.col("role_bits") == F.col(bits), "role_bits")).alias("role"))
    )
    return rows.join(fit, ["resource_type", bits], "left")


def with_default(column: str, default) -> Column:
    return F.coalesce(F.col(column), F.lit(default))
