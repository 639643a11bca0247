"""Context windows: what of a conversation fits a token budget, truncation, backfill and turn folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.operators import scan

# Tokens that prime a reply; share of the limit from which tool outputs are omitted; their stand-in.
PRIMING = 3
TOOL_SHARE = 0.5
OMITTED = "[OUTPUT_OMITTED_FOR_BREVITY]"


def block(size: int = 512) -> Column:
    return F.floor(F.col("msg") / size)


def suffix_tokens(df: DataFrame, bucket: Column | None = None) -> DataFrame:
    """``suffix``: tokens of this and all later messages of the conversation."""
    bucket = block() if bucket is None else bucket
    return scan.with_running(df, ["conv_id"], ["msg"], bucket, {"suffix": ("sum", F.col("tokens"))}, desc=True)


def within_limit(df: DataFrame, limit: int, instructions: int | None = None) -> DataFrame:
    """``in_context`` and ``remaining`` per conversation: newest messages while their tokens fit.

    With instructions (their token count) the first message holds them: it is always part of the context and counts
    against the limit.
    """
    room = limit - (instructions or 0)
    summed = suffix_tokens(df)
    fits = (F.lit(PRIMING) + F.col("suffix") <= room) & (F.lit(PRIMING) + F.col("suffix") - F.col("tokens") < room)
    first = F.col("msg") == F.col("_first")
    used = F.when(F.col("_fits") & ~(first & F.lit(instructions is not None)), F.col("tokens")).otherwise(0)
    bounds = df.groupBy("conv_id").agg(F.min("msg").alias("_first"))
    marked = scan.with_key_row(summed, bounds, ["conv_id"], block()).withColumn("_fits", fits)
    spent = marked.groupBy("conv_id").agg((F.lit(room - PRIMING) - F.sum(used)).alias("remaining"))
    inside = F.col("_fits") | (first & F.lit(instructions is not None))
    return scan.with_key_row(marked.withColumn("in_context", inside), spent, ["conv_id"], block()).drop("suffix", "_first", "_fits")


def omit_tool_outputs(df: DataFrame, limit: int, parts: str = "parts") -> DataFrame:
    """Tool outputs replaced in all messages from which on the newer ones reach half of the limit; ``edited`` tells."""
    over = F.col("suffix") + PRIMING >= limit * TOOL_SHARE
    has = F.exists(parts, lambda p: (p["type"] == "tool_call") & (F.coalesce(p["output"], F.lit("")) != ""))
    swap = F.transform(
        parts,
        lambda p: F.when(
            (p["type"] == "tool_call") & (F.coalesce(p["output"], F.lit("")) != ""), p.withField("output", F.lit(OMITTED))
        ).otherwise(p),
    )
    return (
        suffix_tokens(df)
        .withColumn("edited", over & has)
        .withColumn(parts, F.when(F.col("edited"), swap).otherwise(F.col(parts)))
        .drop("suffix")
    )


def token_backfill(df: DataFrame, counts: Column) -> DataFrame:
    """(conv_id, msg, tokens) to store: rows without a count, except the last message of each conversation."""
    last = df.groupBy("conv_id").agg(F.max("msg").alias("_last"))
    return (
        scan.with_key_row(df, last, ["conv_id"], block())
        .filter((F.col("msg") < F.col("_last")) & F.col("tokens").isNull())
        .select("conv_id", "msg", counts.alias("tokens"))
    )


def fold_turns(df: DataFrame) -> DataFrame:
    """Resulting rows of a synced thread: (conv_id, turn_no, first, role, members, parent_turn).

    ``df`` is (conv_id, msg, role, known). A new assistant row folds into the resulting row before it when that is an
    assistant's too; everything else starts a row of its own. ``island`` numbers the resulting rows.
    """
    before = scan.with_previous(df, ["conv_id"], ["msg"], block(), {"_before": "role"})
    folds = ~F.col("known") & (F.col("role") == "assistant") & (F.coalesce("_before", F.lit("")) == "assistant")
    starts = before.withColumn("_start", F.when(folds, 0).otherwise(1).cast("bigint"))
    return scan.with_running(starts, ["conv_id"], ["msg"], block(), {"island": ("sum", F.col("_start"))}).drop(
        "_before", "_start"
    )
