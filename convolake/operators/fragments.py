"""Long values kept as ordered fragments: one row (keys, position, fragment) per part, whatever their number.

A key's value is never built while it is stored or moved; readers ask for whole values up to a size, or for rows in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.operators import scan
from convolake.session import cut_lineage

WHOLE = 1 << 24  # characters of a value that a reader builds


def fragments(df: DataFrame, keys: list[str], order: list[str], bucket: Column, fragment: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, position from 0, fragment, carried columns) in the order given inside each key."""
    numbered = scan.with_number(df.withColumn("fragment", fragment), keys, order, bucket, "position")
    return numbered.select(*keys, (F.col("position") - 1).alias("position"), "fragment", *carry)


def block(size: int = 512) -> Column:
    return F.floor(F.col("position") / size)


def whole(parts: DataFrame, keys: list[str], separator: str = "", most: int = WHOLE) -> DataFrame:
    """(keys, n, chars, value): the fragments of each key joined; null where that takes more than ``most`` characters.

    Longer values are read with ``in_order``.
    """
    chars = F.sum(F.length("fragment")) + (F.count("*") - 1) * len(separator)
    sizes = parts.groupBy(*keys).agg(F.count("*").alias("n"), chars.alias("chars"))
    short = scan.with_key_row(parts, sizes.filter(F.col("chars") <= most).select(*keys), keys, block())
    built = short.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "fragment"))).alias("_parts"))
    joined = built.select(*keys, F.array_join("_parts.fragment", separator).alias("value"))
    return sizes.join(joined, keys, "left")


def joined(df: DataFrame, keys: list[str], order: list[str], fragment: Column, separator: str = "", most: int = WHOLE, placed: bool = False) -> DataFrame:
    """``whole`` straight from rows that are not numbered yet: (keys, n, chars, value), if asked also the fragments as ``placed``.

    Those are ``position:fragment``, joined the same way; null as well where that takes more than ``most`` characters.

    Sizes are summed before anything is gathered. The few keys over ``most`` leave the rows first, so that a task never gathers
    them; the rows of all others move once.
    """
    rows = df.select(*keys, F.struct(*order, fragment.alias("_fragment")).alias("_row"))
    chars = F.sum(F.length("_row._fragment")) + (F.count("*") - 1) * len(separator)
    # null keys meet as the other keys do
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_l_{k}"]) for k in keys])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), chars.alias("chars"))
    long = cut_lineage(sizes.filter(F.col("chars") > most).withColumn("value", F.lit(None).cast("string")))
    if not long.isEmpty():
        over = long.select(*[F.col(k).alias(f"_l_{k}") for k in keys])
        rows = rows.join(over, same(rows, over), "left_anti")
    shape = [F.array_join(F.transform("_rows", lambda r: r["_fragment"]), separator).alias("value")]
    if placed:
        places = F.array_join(F.transform("_rows", lambda r, i: F.concat(i.cast("string"), F.lit(":"), r["_fragment"])), separator)
        digits = F.length(F.col("n").cast("string")) + 1
        shape.append(F.when(F.col("chars") + F.col("n") * digits <= most, places).alias("placed"))
        long = long.withColumn("placed", F.lit(None).cast("string"))
    short = rows.groupBy(*keys).agg(F.count("*").alias("n"), chars.alias("chars"), F.sort_array(F.collect_list("_row")).alias("_rows"))
    short = short.select(*keys, "n", "chars", *shape)
    return short.unionByName(long)


def in_order(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in ranges of (keys, position), sorted: files written from them follow each other."""
    return parts.repartitionByRange(*keys, "position").sortWithinPartitions(*keys, "position")
