"""Expressions over ordered content parts: ``array<struct<type, text, think, name, args, output, ...>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convolake.functions.text import let, token_estimate, trim_space
from convolake.functions.tokenizers import Tokenizer


def _of_type(parts: Column, *types: str) -> Column:
    return F.filter(parts, lambda p: p["type"].isin(*types))


def plain_text(parts: Column) -> Column:
    """Text parts joined by a space."""
    texts = F.filter(_of_type(parts, "text"), lambda p: p["text"].isNotNull())
    return trim_space(F.array_join(F.transform(texts, lambda p: p["text"]), " "))


def spaced_text(parts: Column, skip_reasoning: bool = False) -> Column:
    """Text (and reasoning) parts joined; a space goes between two parts only where neither brings one."""
    shown = _of_type(parts, *(("text",) if skip_reasoning else ("text", "think")))
    values = F.transform(
        shown, lambda p: F.coalesce(F.when(p["type"] == "text", p["text"]).otherwise(p["think"]), F.lit(""))
    )

    def join(acc: Column, x: Column) -> Column:
        gap = (F.length(acc) > 0) & (F.length(x) > 0) & ~acc.endswith(" ") & ~x.startswith(" ")
        return F.concat(acc, F.when(gap, " ").otherwise(""), x)

    return F.aggregate(values, F.lit(""), join)


def collapsed(parts: Column) -> Column:
    """One string when every part is text, else null."""
    lines = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return F.when(F.forall(parts, lambda p: p["type"] == "text"), trim_space(lines))


def message_tokens(role: Column, parts: Column, name: Column | None = None) -> Column:
    """Tokens of one message: 3 for the frame, role, parts without reasoning, errors and images, 1 per name."""

    def counted(value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(token_estimate(value))

    body = F.aggregate(
        _of_type(parts, "text", "tool_call"),
        F.lit(0).cast("bigint"),
        lambda acc, p: acc
        + F.when(p["type"] == "text", counted(p["text"])).otherwise(
            counted(p["name"]) + counted(p["args"]) + counted(p["output"])
        ),
    )
    total = F.lit(3) + token_estimate(role) + body
    return total if name is None else total + F.when(name.isNotNull(), counted(name) + 1).otherwise(0)


def counted_message_tokens(role: Column, parts: Column, tokenizer: Tokenizer) -> Column:
    """``message_tokens`` with any tokenizer: all counted texts of a message go to it as one array."""
    given = lambda *values: F.filter(F.array(*values), lambda v: F.coalesce(v, F.lit("")) != "")
    texts = F.flatten(
        F.transform(
            _of_type(parts, "text", "tool_call"),
            lambda p: F.when(p["type"] == "text", given(p["text"])).otherwise(given(p["name"], p["args"], p["output"])),
        )
    )
    return F.lit(3) + tokenizer.total(F.concat(F.array(role), texts))


def latest_text(text: Column, parts: Column, with_index: bool = False) -> Column:
    """The text itself, else the last non-empty text part (with its index if asked), else empty."""
    numbered = F.transform(parts, lambda p, i: F.struct(p["type"].alias("type"), p["text"].alias("text"), i.alias("i")))
    last = F.element_at(
        F.concat(
            F.array(F.lit(None).cast("string")),
            F.transform(
                F.filter(numbered, lambda p: (p["type"] == "text") & (F.length(p["text"]) > 0)),
                lambda p: F.concat_ws("-", p["text"], p["i"].cast("string")) if with_index else p["text"],
            ),
        ),
        -1,
    )
    return F.coalesce(F.when(text != "", text), last, F.lit(""))


def all_text(text: Column, parts: Column) -> Column:
    texts = F.filter(_of_type(parts, "text"), lambda p: F.length(p["text"]) > 0)
    return F.coalesce(F.when(text != "", text), F.array_join(F.transform(texts, lambda p: p["text"]), "\n"))


def change_key(message_id: Column, text: Column, conversation_id: Column) -> Column:
    """Id, length and last ten characters: changes whenever a growing message does."""
    tail = F.when(F.length(text) > 0, F.concat(F.length(text).cast("string"), F.right(text, F.lit(10)))).otherwise("0")
    return F.concat_ws("__", message_id, tail, conversation_id)


def payload_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"), 1, 64)


def split_rows(parts: Column) -> Column:
    """Message rows of an assistant's parts: ``array<struct<kind, name, content>>``.

    Text that announces tool calls takes the pending text with it, each tool call gives one tool row, reasoning and
    errors are left out, the rest becomes the closing row.
    """
    row = lambda kind, name, content: F.struct(
        F.lit(kind).alias("kind"), name.cast("string").alias("name"), content.alias("content")
    )
    none = F.lit(None)
    rows_type = "array<struct<kind:string,name:string,content:string>>"
    text = lambda p: F.coalesce(p["text"], F.lit(""))
    lines = lambda pending: F.array_join(F.transform(pending, lambda x: F.concat(x, F.lit("\n"))), "")
    start = F.struct(F.array().cast(rows_type).alias("rows"), F.array().cast("array<string>").alias("pending"))

    def step(acc: Column, p: Column) -> Column:
        announced = F.when(
            F.size(acc["pending"]) > 0, trim_space(F.concat(lines(acc["pending"]), F.lit("\n"), text(p)))
        ).otherwise(text(p))
        return (
            F.when(
                (p["type"] == "text") & p["announces"],
                F.struct(
                    F.concat(acc["rows"], F.array(row("assistant", none, announced))).alias("rows"),
                    F.array().cast("array<string>").alias("pending"),
                ),
            )
            .when(
                p["type"] == "tool_call",
                F.struct(
                    F.concat(
                        acc["rows"], F.array(row("tool", p["name"], F.coalesce(p["output"], F.lit(""))))
                    ).alias("rows"),
                    acc["pending"].alias("pending"),
                ),
            )
            .when(p["type"].isin("think", "error", "agent_update"), acc)
            .otherwise(
                F.struct(acc["rows"].alias("rows"), F.concat(acc["pending"], F.array(text(p))).alias("pending"))
            )
        )

    def finish(acc: Column) -> Column:
        closing = F.array(row("assistant", none, trim_space(lines(acc["pending"]))))
        return F.concat(acc["rows"], F.when(F.size(acc["pending"]) > 0, closing).otherwise(F.array().cast(rows_type)))

    return F.aggregate(parts, start, step, finish)


def splice(text: Column, edits: Column) -> Column:
    """Apply ``array<struct<start, end, text>>`` (0-based, end exclusive) from the right to the left."""
    ordered = F.array_sort(
        edits,
        lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0),
    )
    return F.aggregate(
        ordered,
        text,
        lambda acc, e: F.concat(
            F.substr(acc, F.lit(1), e["start"].cast("int")), e["text"], F.substr(acc, e["end"].cast("int") + 1)
        ),
    )


def matches_with_offsets(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, match>>`` of every match of the pattern (0-based, end exclusive)."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        first = acc["at"] + F.length(pair["gap"])
        last = first + F.length(pair["match"])
        item = F.struct(first.alias("start"), last.alias("end"), pair["match"].alias("match"))
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    return let(
        found,
        lambda m: F.aggregate(
            F.zip_with(F.slice(gaps, 1, F.greatest(F.size(m), F.lit(0))), m, lambda g, x: F.struct(g.alias("gap"), x.alias("match"))),
            start,
            step,
            lambda acc: acc["out"],
        ),
    )
