"""Message forests keyed by (conv_id, msg, parent): folds along the path to the root, levels, splits, order.

All walks use pointer doubling: a row's pointer jumps to its ancestor's pointer, so a forest of depth d takes about
log2(d) self-joins on (conversation, message). Nothing is grouped by conversation, so one huge conversation spreads over
all tasks like any other rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.operators import scan
from convolake.session import cut_lineage
from convolake.sources.tables import ROOT

KEY = ["conv_id", "msg"]
_FOLD = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}


def _block(column: str = "msg", size: int = 512) -> Column:
    return F.floor(F.col(column) / size)


def _linked(df: DataFrame, columns: list) -> DataFrame:
    """Rows with ``anc``: the parent where it exists in the table, else null."""
    known = df.select("conv_id", F.col("msg").alias("parent"), F.lit(True).alias("_known"))
    return df.join(known, ["conv_id", "parent"], "left").select(
        *KEY, F.when(F.col("_known"), F.col("parent")).alias("anc"), *columns
    )


def fold_to_root(df: DataFrame, folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add folds over each row's path (itself included), its ``root`` and ``resolved``.

    A row whose parent is missing is a root. Rows that never reach a root lie on or below a cycle: ``resolved`` is
    false and their folds are null.
    """
    columns = [expr.alias(f"_f_{name}") for name, (_, expr) in folds.items()]
    state = cut_lineage(
        _linked(df, columns).withColumn("root", F.when(F.col("anc").isNull(), F.col("msg")))
    )
    open_rows, number = state.filter("anc IS NOT NULL").count(), 0
    while open_rows:
        number += 1
        above = state.select(
            "conv_id",
            F.col("msg").alias("anc"),
            F.col("anc").alias("_anc"),
            F.col("root").alias("_root"),
            *[F.col(f"_f_{n}").alias(f"_a_{n}") for n in folds],
        )
        state = cut_lineage(
            state.join(above, ["conv_id", "anc"], "left").select(
                *KEY,
                F.col("_anc").alias("anc"),
                *[
                    F.when(F.col("anc").isNull(), F.col(f"_f_{n}"))
                    .otherwise(_FOLD[kind](F.col(f"_f_{n}"), F.col(f"_a_{n}")))
                    .alias(f"_f_{n}")
                    for n, (kind, _) in folds.items()
                ],
                F.coalesce("root", "_root").alias("root"),
            ),
            number,
        )
        left = state.filter("anc IS NOT NULL").count()
        if left == open_rows:  # a round that closes nothing leaves only cycles
            break
        open_rows = left
    done = F.col("anc").isNull()
    result = state.select(
        *KEY,
        "root",
        done.alias("resolved"),
        *[F.when(done, F.col(f"_f_{n}")).alias(n) for n in folds],
    )
    return df.join(result, KEY)


def depths(df: DataFrame) -> DataFrame:
    """Forest with ``depth`` (0 at a root), ``root`` and ``resolved``."""
    return fold_to_root(df, {"depth": ("sum", F.lit(1).cast("bigint"))}).withColumn("depth", F.col("depth") - 1)


def paths(df: DataFrame, targets: DataFrame) -> DataFrame:
    """(conv_id, target, msg, up): every message on the way from a target to its root; a cycle is walked once."""
    jump = cut_lineage(_linked(df, []).filter("anc IS NOT NULL"))
    present = df.select(*KEY)
    seen = cut_lineage(
        targets.select("conv_id", "target", F.col("target").alias("msg"))
        .join(present, KEY, "left_semi")
        .withColumn("up", F.lit(0).cast("bigint"))
        .select("conv_id", "target", "msg", "up")
    )
    step, size, number = 1, seen.count(), 0
    while size:
        number += 1
        further = seen.join(jump, KEY).select(
            "conv_id", "target", F.col("anc").alias("msg"), (F.col("up") + step).alias("up")
        )
        seen = cut_lineage(
            seen.unionByName(further).groupBy("conv_id", "target", "msg").agg(F.min("up").alias("up")), number
        )
        grown = seen.count()
        if grown == size:
            break
        size, step = grown, step * 2
        above = jump.select("conv_id", F.col("msg").alias("anc"), F.col("anc").alias("_anc"))
        jump = cut_lineage(jump.join(above, ["conv_id", "anc"]).select(*KEY, F.col("_anc").alias("anc")), number)
    return seen


def path_to_root(df: DataFrame, targets: DataFrame, summary: str | None = None) -> DataFrame:
    """Messages from root to target with ``position``; a summary replaces all that comes before it."""
    walk = paths(df, targets)
    rows = df.join(walk, KEY)
    if summary is not None:
        # the nearest summary on the way up ends the walk
        cut = rows.filter(F.col(summary).isNotNull()).groupBy("conv_id", "target").agg(F.min("up").alias("_cut"))
        rows = scan.with_key_row(rows, cut, ["conv_id", "target"], _block("up"), "left").filter(F.col("_cut").isNull() | (F.col("up") <= F.col("_cut")))
        rows = rows.withColumns(
            {
                "text": F.coalesce(summary, "text"),
                "role": F.when(F.col(summary).isNotNull(), "system").otherwise(F.col("role")),
            }
        ).drop("_cut")
    length = rows.groupBy("conv_id", "target").agg(F.max("up").alias("_top"))
    whole = scan.with_key_row(rows, length, ["conv_id", "target"], _block("up"))
    return whole.withColumn("position", F.col("_top") - F.col("up")).drop("_top")


def path_with_siblings(df: DataFrame, targets: DataFrame) -> DataFrame:
    """The path and every message hanging from it, without the children of the target."""
    walk = paths(df, targets)
    on_path = walk.select(*KEY, "target")
    below = walk.filter("msg <> target").select("conv_id", F.col("msg").alias("parent"), "target")
    members = df.join(on_path, KEY).select(*KEY, "target").unionByName(
        df.join(below, ["conv_id", "parent"]).select(*KEY, "target")
    )
    return df.join(members.distinct(), KEY)


def rooted_levels(df: DataFrame) -> DataFrame:
    """``level`` below a first message; null under a missing parent or a cycle."""
    first = F.when(F.col("parent") == ROOT, F.lit(0)).otherwise(F.lit(1))
    levels = depths(df.withColumn("_first", first))
    tops = levels.filter("depth = 0 AND _first = 0").select("conv_id", F.col("msg").alias("root"), F.lit(True).alias("_top"))
    return (
        scan.with_key_row(levels, tops, ["conv_id", "root"], _block(), "left")
        .withColumn("level", F.when(F.col("_top"), F.col("depth")))
        .drop("_first", "_top", "depth", "resolved", "root")
    )


def _with_target_level(df: DataFrame, targets: DataFrame) -> DataFrame:
    levels = rooted_levels(df)
    wanted = (
        levels.select("conv_id", F.col("msg").alias("target"), F.col("level").alias("target_level"))
        .join(targets, ["conv_id", "target"])
    )
    return scan.with_key_row(levels, wanted, ["conv_id"], _block())


def up_to_target_level(df: DataFrame, targets: DataFrame) -> DataFrame:
    """All reachable messages down to the level of the target; everything reachable if the target is not."""
    return (
        _with_target_level(df, targets)
        .filter(F.col("level").isNotNull() & (F.col("target_level").isNull() | (F.col("level") <= F.col("target_level"))))
        .drop("level", "target_level")
    )


def split_at_target_level(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Messages at and below the target's level; those at the level become first messages."""
    return (
        _with_target_level(df, targets)
        .filter(F.col("target_level").isNotNull() & (F.col("level").isNull() | (F.col("level") >= F.col("target_level"))))
        .withColumn("parent", F.when(F.col("level") == F.col("target_level"), F.lit(ROOT)).otherwise(F.col("parent")))
        .drop("level", "target_level")
    )


def sibling_index(df: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Position among the children of a parent by creation time."""
    bucket = F.date_trunc("hour", "created_at") if bucket is None else bucket
    return scan.with_number(df, ["conv_id", "parent"], ["created_at", "msg"], bucket, "_n").withColumn(
        "sibling", F.col("_n") - 1
    ).drop("_n")


def subtree_sizes(df: DataFrame) -> DataFrame:
    """(conv_id, msg, size): messages in each subtree, by doubling: log2(depth) joins and partial sums."""
    jump = cut_lineage(_linked(df, []).filter("anc IS NOT NULL"))
    sizes = cut_lineage(df.select(*KEY, F.lit(1).cast("bigint").alias("size")))
    active, number = jump.count(), 0
    while active:
        number += 1
        given = (
            jump.join(sizes, KEY).groupBy("conv_id", F.col("anc").alias("msg")).agg(F.sum("size").alias("_more"))
        )
        sizes = cut_lineage(
            sizes.join(given, KEY, "left").select(*KEY, (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")), number
        )
        above = jump.select("conv_id", F.col("msg").alias("anc"), F.col("anc").alias("_anc"))
        jump = cut_lineage(jump.join(above, ["conv_id", "anc"]).select(*KEY, F.col("_anc").alias("anc")), number)
        remaining = jump.count()
        if remaining == active:
            break
        active = remaining
    return sizes


def linearised(df: DataFrame) -> DataFrame:
    """Pre-order ``position`` in the conversation, ``level`` (0 at a root) and ``on_last_branch`` (the newest sibling at every level).

    A row comes after its ancestors and the subtrees of their earlier siblings, so its position is a sum along its
    path.
    """
    sized = sibling_index(df).join(subtree_sizes(df), KEY)
    # roots are siblings of each other: parents that do not exist share the root marker
    before = scan.with_running(
        sized, ["conv_id", "parent"], ["created_at", "msg"], F.date_trunc("hour", "created_at"), {"_upto": ("sum", F.col("size"))}
    )
    last = before.groupBy("conv_id", "parent").agg(F.max("sibling").alias("_last"))
    folded = fold_to_root(
        before.join(last, ["conv_id", "parent"]),
        {
            "_pos": ("sum", F.col("_upto") - F.col("size") + 1),
            "_off": ("sum", F.when(F.col("sibling") == F.col("_last"), 0).otherwise(1)),
            "_deep": ("sum", F.lit(1).cast("bigint")),
        },
    )
    placed = {"position": F.col("_pos") - 1, "level": F.col("_deep") - 1, "on_last_branch": F.col("_off") == 0}
    return folded.withColumns(placed).drop(
        "_pos", "_off", "_deep", "_upto", "_last", "size", "root", "resolved"
    )


def later_than_parent(df: DataFrame) -> DataFrame:
    """``fixed_ms``: creation time pushed at least one millisecond behind the parent's, all along the path."""
    base = df.withColumn("_ms", F.unix_millis(F.col("created_at").cast("timestamp")))
    depth = depths(base).drop("root", "resolved")
    folded = fold_to_root(depth, {"_best": ("max", F.col("_ms") - F.col("depth"))})
    return folded.withColumn("fixed_ms", F.col("_best") + F.col("depth")).drop("_best", "_ms", "root", "resolved")


def clone_id(fork: str, conv: Column, msg: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(fork), conv.cast("string"), msg.cast("string")), 256)


def cloned(df: DataFrame, fork: str) -> DataFrame:
    """Copies with new ids on both ends of every link; a parent outside the copy makes a first message."""
    inside = df.select("conv_id", F.col("msg").alias("parent"), F.lit(True).alias("_in"))
    return later_than_parent(df).join(inside, ["conv_id", "parent"], "left").select(
        "conv_id",
        F.col("msg").alias("source_msg"),
        clone_id(fork, F.col("conv_id"), F.col("msg")).alias("new_id"),
        F.when(F.col("_in"), clone_id(fork, F.col("conv_id"), F.col("parent"))).alias("new_parent"),
        "text",
        "fixed_ms",
    )


def fork(df: DataFrame, targets: DataFrame, option: str, fork_id: str, split_latest: DataFrame | None = None) -> DataFrame:
    """Copy of a conversation: ``direct_path``, ``include_branches`` or ``target_level``.

    With ``split_latest`` the conversation is first split at the target's level and then followed to those messages.
    """
    if split_latest is not None:
        df, targets = cut_lineage(split_at_target_level(df, targets).select(*df.columns)), split_latest
    pick = {"direct_path": path_to_root, "include_branches": path_with_siblings, "target_level": up_to_target_level}
    return cloned(cut_lineage(pick[option](df, targets).select(*df.columns)), fork_id)


def audit(df: DataFrame) -> DataFrame:
    """(conv_id, msg, problem) for rows with a missing parent or without a way to a root."""
    walk = depths(df)
    known = df.select("conv_id", F.col("msg").alias("parent"))
    orphans = df.filter(F.col("parent") != ROOT).join(known, ["conv_id", "parent"], "left_anti")
    tag = lambda rows, name: rows.select(*KEY, F.lit(name).alias("problem"))
    return functools.reduce(DataFrame.unionByName, [tag(orphans, "orphan"), tag(walk.filter("NOT resolved"), "cycle")])
