"""Writers of conversations: CSV rows, JSON lines and documents, Markdown and text transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.operators import fragments, scan
from convolake.operators.trees import linearised
from convolake.session import cut_lineage

# Columns of the CSV export, in order.
CSV_COLUMNS = ["sender", "text", "isCreatedByUser", "error", "unfinished", "messageId", "parentMessageId", "createdAt"]


# Head lines of the Markdown and of the text transcript, and notes on messages.
MD_HEAD, MD_HISTORY = "# Conversation\n- conversationId: ", "\n\n## History"
TEXT_HEAD, TEXT_HISTORY = "Conversation\n########################\nconversationId: ", "\n\nHistory\n########################"


def csv_rows(messages: DataFrame, branches: bool = True) -> DataFrame:
    """Export rows with their order; the chosen branch only when ``branches`` is off."""
    rows = linearised(messages)
    if not branches:
        rows = rows.filter("on_last_branch")
    return rows.select(
        "conv_id",
        "position",
        F.col("role").alias("sender"),
        "text",
        (F.col("role") == "user").alias("isCreatedByUser"),
        F.lit(False).alias("error"),
        F.lit(False).alias("unfinished"),
        F.col("msg").alias("messageId"),
        F.col("parent").alias("parentMessageId"),
        F.col("created_at").alias("createdAt"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows range-partitioned and sorted, so the files of a huge conversation follow each other."""
    return rows.repartitionByRange("conv_id", "position").sortWithinPartitions("conv_id", "position")


def write_csv(messages: DataFrame, path: str, branches: bool = True) -> None:
    """The eight columns behind the conversation's id; many conversations share one set of ordered files."""
    rows = in_order(csv_rows(messages, branches))
    rows.select("conv_id", *CSV_COLUMNS).write.csv(path, header=True, quoteAll=True, escape='"')


def transcript(messages: DataFrame, style: str = "md") -> DataFrame:
    """(conv_id, position, line): a head, then one block per message of the chosen branch.

    A transcript is the blocks in order; it is never built as one string.
    """
    md = style == "md"
    head_text = F.concat(F.lit(MD_HEAD if md else TEXT_HEAD), F.col("conv_id").cast("string"), F.lit(MD_HISTORY if md else TEXT_HISTORY))
    body = (
        F.concat(F.lit("**"), "role", F.lit("**\n"), "text") if md else F.concat(F.lit(">> "), "role", F.lit(":\n"), "text")
    )
    note = lambda flag, text: F.when(
        F.coalesce(F.col(flag), F.lit(False)), F.lit(f"\n*(This is an {text} message)*" if md else f"\n(This is an {text} message)")
    ).otherwise("")
    for flag in ("error", "unfinished"):
        if flag not in messages.columns:
            messages = messages.withColumn(flag, F.lit(False))
    blocks = linearised(messages).filter("on_last_branch").select(
        "conv_id", "position", F.concat(body, note("error", "error"), note("unfinished", "unfinished")).alias("line")
    )
    heads = messages.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("bigint").alias("position"), head_text.alias("line"))
    return heads.unionByName(blocks)


def json_lines(messages: DataFrame, columns: list[str]) -> DataFrame:
    """(conv_id, position, json): one object per message in pre-order."""
    return linearised(messages).select("conv_id", "position", F.to_json(F.struct(*columns)).alias("json"))


def nested_fragments(messages: DataFrame, head: Column) -> DataFrame:
    """(conv_id, position, fragment): the messages as nested ``children``, in pre-order, to be joined without separator.

    ``head`` is a message's JSON object without children. A fragment opens its message and closes those that end before the
    next one, so a tree of any size and depth is written row by row; the joined fragments are the items of one array.
    """
    rows = linearised(messages).withColumn("_head", head).select("conv_id", "position", "level", "sibling", "_head")
    rows = cut_lineage(rows)
    # positions are read from the end: the row before is the next one in the document
    after = scan.with_previous(rows, ["conv_id"], ["position"], fragments.block(), {"_next": "level"}, desc=True)
    opened = F.concat(F.substr("_head", F.lit(1), F.length("_head") - 1), F.lit(',"children":['))
    closed = F.repeat(F.lit("]}"), (F.col("level") - F.coalesce("_next", F.lit(0)) + 1).cast("int"))
    comma = F.when(F.col("sibling") > 0, ",").otherwise("")
    return after.select("conv_id", "position", F.concat(comma, opened, closed).alias("fragment"))


def message_head(created: Column | None = None) -> Column:
    """The JSON object of a message as nested exports write it; null fields are left out."""
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if created is None else created
    return F.to_json(F.struct(F.col("msg").cast("string").alias("messageId"), "text", F.col("role").alias("sender"), at.alias("createdAt")))


def nested_documents(messages: DataFrame, title: Column, head: Column | None = None) -> DataFrame:
    """(conv_id, n, json): one recursive export per conversation, null where it is too long for one value."""
    parts = nested_fragments(messages, message_head() if head is None else head)
    whole = fragments.whole(parts, ["conv_id"])
    lead = F.concat(F.lit('{"conversationId":"'), F.col("conv_id").cast("string"), F.lit('","title":'), F.to_json(F.array(title)))
    # to_json of an array quotes the title; its brackets go
    lead = F.regexp_replace(lead, r'"title":\[(.*)\]$', '"title":$1')
    return whole.select("conv_id", "n", F.concat(lead, F.lit(',"recursive":true,"messagesTree":['), "value", F.lit("]}")).alias("json"))
