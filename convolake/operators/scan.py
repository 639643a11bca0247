"""Running aggregates, numbering and look-back that stay parallel inside a hot key.

A plain window puts a whole key into one task. These helpers cut a key into ordered buckets: the rows of one
(key, bucket) are scanned together, one row of totals per bucket is carried forward, and both are joined back. The
bucket column must rise with the order columns (a time grain, a block of positions). Without keys the buckets are scanned
in ranges of their own, so that one row per range is all that ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from convolake.session import cut_lineage

_FOLD = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}
_CARRIED = {"sum": lambda c: F.coalesce(c, F.lit(0)), "min": lambda c: c, "max": lambda c: c}


def _cut(df: DataFrame, keys: list[str], bucket: Column) -> tuple[DataFrame, list[str], list[str]]:
    """Rows with plain key columns and the bucket, and the names of both: (frame, key columns, key columns + bucket).

    A null key is replaced by a zero of its type and a flag, so plain equality meets it and the scan and the join back
    share one partitioning. The bucket must not be null.
    """
    columns, names = {}, []
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        zero = F.lit("") if isinstance(kind, StringType) else F.lit(0).cast(kind) if isinstance(kind, NumericType) else None
        value = F.col(key).cast("string") if zero is None else F.col(key)
        columns[f"_k{i}"] = F.coalesce(value, F.lit("") if zero is None else zero)
        columns[f"_z{i}"] = F.col(key).isNull()
        names += [f"_k{i}", f"_z{i}"]
    return df.withColumns(columns | {"_bucket": bucket}), names, [*names, "_bucket"]


def _earlier(names: list[str], desc: bool):
    return Window.partitionBy(*names).orderBy(F.col("_bucket").desc() if desc else F.col("_bucket").asc())


def _ranges(totals: DataFrame) -> DataFrame:
    """The buckets of a table without keys, dealt to ranges: ``_part`` rises with the bucket. Fixed, as ranges are sampled."""
    return cut_lineage(totals.repartitionByRange("_bucket").withColumn("_part", F.spark_partition_id()))


def _carried(totals: DataFrame, names: list[str], folds: dict[str, tuple[str, Column]], desc: bool = False) -> DataFrame:
    """``totals``, one row per bucket, with folds over the buckets before each: ``folds`` maps new column to (kind, column)."""
    before = Window.unboundedPreceding, -1
    if names:
        window = _earlier(names, desc).rowsBetween(*before)
        return totals.withColumns({new: _FOLD[kind][0](column).over(window) for new, (kind, column) in folds.items()})
    ranged = _ranges(totals)
    parts = ranged.groupBy("_part").agg(*[_FOLD[kind][0](column).alias(f"_t_{new}") for new, (kind, column) in folds.items()])
    ahead = Window.orderBy(F.col("_part").desc() if desc else F.col("_part").asc()).rowsBetween(*before)
    parts = parts.select("_part", *[_FOLD[kind][0](f"_t_{new}").over(ahead).alias(f"_p_{new}") for new, (kind, _) in folds.items()])
    local = _earlier(["_part"], desc).rowsBetween(*before)
    both = {
        new: F.coalesce(_FOLD[kind][1](F.col(f"_p_{new}"), _FOLD[kind][0](column).over(local)), F.col(f"_p_{new}"), _FOLD[kind][0](column).over(local))
        for new, (kind, column) in folds.items()
    }
    # as many rows as there are ranges
    return ranged.join(F.broadcast(parts), "_part").withColumns(both).drop("_part", *[f"_p_{new}" for new in folds])


def _in_order(order: list[str], desc: bool) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c in order]


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    running: dict[str, tuple[str, Column]],
    desc: bool = False,
) -> DataFrame:
    """Add running aggregates (first row up to this one) of the given kinds.

    ``running`` maps a new column to (``sum`` | ``min`` | ``max``, expression).
    """
    cut, names, cell = _cut(df, keys, bucket)
    local = Window.partitionBy(*cell).orderBy(*_in_order(order, desc)).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*cell).agg(*[_FOLD[kind][0](expr).alias(f"_t_{name}") for name, (kind, expr) in running.items()])
    carry = _carried(totals, names, {f"_c_{name}": (kind, F.col(f"_t_{name}")) for name, (kind, _) in running.items()}, desc)
    carry = carry.select(*cell, *[f"_c_{name}" for name in running])
    rows = cut.withColumns({name: _FOLD[kind][0](expr).over(local) for name, (kind, expr) in running.items()})
    merged = {
        name: F.coalesce(
            _FOLD[kind][1](F.col(name), _CARRIED[kind](F.col(f"_c_{name}"))), F.col(name), F.col(f"_c_{name}")
        )
        for name, (kind, _) in running.items()
    }
    return rows.join(carry, cell).withColumns(merged).select(*df.columns, *running)


def with_clamped(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, delta: Column, opening: Column | float = 0.0
) -> DataFrame:
    """Add ``raw`` (opening value plus running sum) and ``low`` (its least value so far).

    A running value that never falls below zero is ``raw - least(0, low)``: what is missing to zero at the deepest point
    stays added. One scan of the rows and one row per bucket give both columns.
    """
    cut, names, cell = _cut(df, keys, bucket)
    local = Window.partitionBy(*cell).orderBy(*_in_order(order, False)).rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        cut.withColumn("_delta", delta)
        .withColumn("_s", F.sum("_delta").over(local))
        .withColumn("_m", F.min("_s").over(local))
    )
    start = opening if isinstance(opening, Column) else F.lit(float(opening))
    totals = rows.groupBy(*cell).agg(F.sum("_delta").alias("_total"), F.min("_m").alias("_least"))
    based = _carried(totals, names, {"_base": ("sum", F.col("_total"))}).withColumn("_base", F.coalesce("_base", F.lit(0.0)))
    carry = _carried(based, names, {"_floor": ("min", F.col("_base") + F.col("_least"))}).select(*cell, "_base", "_floor")
    return (
        rows.join(carry, cell)
        .withColumn("raw", start + F.col("_base") + F.col("_s"))
        .withColumn("low", start + F.least(F.col("_floor"), F.col("_base") + F.col("_m")))
        .select(*df.columns, "raw", "low")
    )


def with_number(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "rn", desc: bool = False
) -> DataFrame:
    """Row number from 1 inside each key (the whole table when ``keys`` is empty)."""
    return with_running(df, keys, order, bucket, {name: ("sum", F.lit(1).cast("bigint"))}, desc)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, previous: dict[str, str], desc: bool = False
) -> DataFrame:
    """Value of the row before this one inside the key; ``previous`` maps new column to source column."""
    cut, names, cell = _cut(df, keys, bucket)
    local = Window.partitionBy(*cell).orderBy(*_in_order(order, desc))
    last = F.min_by if desc else F.max_by
    ends = cut.groupBy(*cell).agg(
        last(F.struct(*[F.col(src).alias(name) for name, src in previous.items()]), F.struct(*order)).alias("_last")
    )
    if names:
        carry = ends.select(*cell, F.lag("_last").over(_earlier(names, desc)).alias("_carry_row"))
    else:
        ranged = _ranges(ends)
        parts = ranged.groupBy("_part").agg(last("_last", "_bucket").alias("_end"))
        ahead = Window.orderBy(F.col("_part").desc() if desc else F.col("_part").asc())
        parts = parts.select("_part", F.lag("_end").over(ahead).alias("_end"))
        here = F.lag("_last").over(_earlier(["_part"], desc))
        carry = ranged.join(F.broadcast(parts), "_part").select(*cell, F.coalesce(here, "_end").alias("_carry_row"))
    rows = cut.withColumns(
        {"_first": F.row_number().over(local) == 1}
        | {name: F.lag(src).over(local) for name, src in previous.items()}
    )
    merged = {name: F.when(F.col("_first"), F.col("_carry_row")[name]).otherwise(F.col(name)) for name in previous}
    return rows.join(carry, cell).withColumns(merged).select(*df.columns, *previous)


def with_key_row(df: DataFrame, row: DataFrame, keys: list[str], bucket: Column, how: str = "inner") -> DataFrame:
    """Each row with the columns of its key's one row in ``row``.

    That row is first brought to the (key, bucket) cells and joined from there, so that the rows of a hot key spread over
    its buckets instead of meeting in one task. ``how`` is inner or left; the bucket must not be null.
    """
    cut, _, cell = _cut(df, keys, bucket)
    added = [c for c in row.columns if c not in keys]
    cells = cut.select(*cell, *keys).distinct().join(row, keys, how)
    return cut.join(cells.select(*cell, *added), cell).select(*df.columns, *added)


def packed_lists(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, size: int = 1000
) -> DataFrame:
    """Ordered lists per key in blocks of at most ``size`` values: (keys, block, items). No row is dropped."""
    return (
        with_number(df.withColumn("_value", value), keys, order, bucket, "_rn")
        .withColumn("block", F.floor((F.col("_rn") - 1) / size))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "_value"))).alias("_list"))
        .select(*keys, "block", F.col("_list._value").alias("items"))
    )
