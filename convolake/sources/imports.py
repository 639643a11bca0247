"""Readers of exported conversations: detection of the format, three importers, message bodies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions.content import splice
from convolake.operators.trees import fold_to_root
from convolake.session import cut_lineage

# Fixed value: parent of a first message.
NO_PARENT = "00000000-0000-0000-0000-000000000000"
# Model of messages that name none, and sender names by model.
DEFAULT_MODEL, DEFAULT_SENDER, SENDER_4 = "gpt-4o-mini", "GPT-3.5", "GPT-4"

_CITATION = "struct<start_ix:int,end_ix:int,metadata:struct<type:string,title:string,url:string>>"
NODE_MAP = f"""struct<title:string,create_time:double,mapping:map<string,struct<parent:string,message:struct<
  author:struct<role:string>,
  content:struct<content_type:string,parts:array<string>,language:string,text:string>,
  metadata:struct<model_slug:string,citations:array<{_CITATION}>>>>>>"""
HISTORY = "struct<version:int,history:array<struct<id:string,name:string,model:struct<id:string>,messages:array<struct<role:string,content:string>>>>>"


def json_format(document: Column) -> Column:
    """``node_map`` (array), ``history`` (version and history), ``tree`` (own export), else ``unsupported``."""
    v = F.try_parse_json(document)
    has = lambda path: F.try_variant_get(v, path, "string").isNotNull()
    kind = F.schema_of_variant(v)
    truthy = lambda path: ~F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")).isin("", "0", "false")
    return (
        F.when(v.isNull(), "unsupported")
        .when(kind.startswith("ARRAY"), "node_map")
        .when(truthy("$.version") & F.schema_of_variant(F.try_variant_get(v, "$.history", "variant")).startswith("ARRAY"), "history")
        .when(truthy("$.conversationId") & (has("$.messagesTree") | has("$.messages")), "tree")
        .otherwise("unsupported")
    )


def message_body(content: Column, fallback: Column) -> Column:
    """Text of a typed body: joined parts, fenced code, quoted output, else the JSON fallback."""
    fence = lambda head, body: F.concat(F.lit(f"```{head}"), body, F.lit("\n```"))
    kind = content["content_type"]
    return (
        F.when((kind == "text") & content["parts"].isNotNull(), F.array_join(content["parts"], " "))
        .when(kind == "code", fence("", F.concat(content["language"], F.lit("\n"), content["text"])))
        .when(kind == "execution_output", F.concat(F.lit("Execution Output:\n> "), content["text"]))
        .when((kind != "other") & content["parts"].isNotNull(), F.trim(F.array_join(content["parts"], " ")))
        .otherwise(fence("json\n", fallback))
    )


def cite(text: Column, citations: Column) -> Column:
    """Links put in place of cited spans; only web pages with a real span count.

    ``citations`` is array<struct<type, start_ix, end_ix, title, url>>.
    """
    valid = F.filter(
        citations,
        lambda c: (c["type"] == "webpage") & c["start_ix"].isNotNull() & (c["start_ix"] < c["end_ix"]),
    )
    edits = F.transform(
        valid,
        lambda c: F.struct(
            c["start_ix"].alias("start"),
            c["end_ix"].alias("end"),
            F.concat(F.lit(" (["), c["title"], F.lit("]("), c["url"], F.lit("))")).alias("text"),
        ),
    )
    return F.when((text != "") & (F.size(edits) > 0), splice(text, edits)).otherwise(text)


def import_node_map(documents: DataFrame, doc: str, json: str) -> DataFrame:
    """Messages of node-map exports (an array of conversations per document).

    Nodes without a message and system nodes go; a child keeps its direct parent only if that was kept, else it starts
    a thread of its own.
    """
    conversations = documents.select(doc, F.posexplode(F.from_json(json, f"array<{NODE_MAP}>")).alias("conv", "c"))
    nodes = conversations.select(
        doc,
        "conv",
        F.col("c.title").alias("title"),
        F.timestamp_seconds("c.create_time").alias("created_at"),
        F.explode("c.mapping").alias("id", "node"),
    )
    message = F.col("node.message")
    kept = nodes.filter(
        message.isNotNull() & (F.coalesce(message["author"]["role"], F.lit("")) != "system")
    )
    has_type = kept.filter(message["content"]["content_type"].isNotNull()).select(
        doc, "conv", F.col("id").alias("parent"), F.lit(True).alias("has_parent")
    )
    role, model = message["author"]["role"], F.coalesce(F.nullif(message["metadata"]["model_slug"], F.lit("")), F.lit(DEFAULT_MODEL))
    body = message_body(message["content"], F.to_json(message["content"]))
    flat = F.transform(
        message["metadata"]["citations"],
        lambda c: F.struct(
            c["metadata"]["type"].alias("type"), c["start_ix"].alias("start_ix"), c["end_ix"].alias("end_ix"),
            c["metadata"]["title"].alias("title"), c["metadata"]["url"].alias("url"),
        ),
    )
    cited = (message["content"]["content_type"] == "text") & (role != "user") & flat.isNotNull()
    new_id = lambda c: F.sha2(F.concat_ws("|", F.col(doc).cast("string"), F.col("conv").cast("string"), c), 256)
    return (
        kept.withColumn("parent", F.col("node.parent"))
        .join(has_type, [doc, "conv", "parent"], "left")
        .select(
            doc,
            "conv",
            "title",
            "created_at",
            F.col("id").alias("source_id"),
            new_id(F.col("id")).alias("message_id"),
            F.when(F.col("has_parent"), new_id(F.col("parent"))).otherwise(NO_PARENT).alias("parent_id"),
            F.when(F.col("has_parent"), F.col("parent")).alias("source_parent"),
            F.when(model.contains("gpt-4"), SENDER_4).when(role == "user", "user").otherwise(DEFAULT_SENDER).alias("sender"),
            (role == "user").alias("is_user"),
            model.alias("model"),
            F.when(cited, cite(body, flat)).otherwise(body).alias("text"),
        )
    )


def import_history(documents: DataFrame, doc: str, json: str) -> DataFrame:
    """Messages of flat histories: user and assistant turns in a chain."""
    items = documents.select(doc, F.posexplode(F.from_json(json, HISTORY)["history"]).alias("conv", "h"))
    shown = items.select(
        doc,
        "conv",
        F.col("h.name").alias("title"),
        F.posexplode(F.filter("h.messages", lambda m: m["role"].isin("user", "assistant"))).alias("pos", "m"),
    )
    ident = lambda pos: F.concat_ws("-", F.col(doc).cast("string"), F.col("conv").cast("string"), pos.cast("string"))
    return shown.select(
        doc,
        "conv",
        "title",
        "pos",
        ident(F.col("pos")).alias("message_id"),
        F.when(F.col("pos") == 0, NO_PARENT).otherwise(ident(F.col("pos") - 1)).alias("parent_id"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("text"),
    )


_SPACE = re.compile(r"[ \t\n\r]*")


def document_nodes(text: str) -> tuple[dict, list[tuple[int, int, int, dict]]]:
    """Fields of an exported conversation and its messages (node, parent node, depth, fields), numbered in document order.

    One walk with a stack of its own, so that neither depth nor size of the nesting is bounded. Raises on broken JSON.
    """
    decode = json.JSONDecoder().raw_decode
    skip = lambda at: _SPACE.match(text, at).end()
    head: dict = {}
    nodes: list[tuple[int, int, int, dict]] = []
    open_: list[tuple[int, dict, tuple[str, ...]]] = [(-1, head, ("messagesTree", "messages"))]
    at, in_object = skip(0), True
    if text[at : at + 1] != "{":
        raise ValueError("no conversation")
    at, count = at + 1, 0
    while open_:
        at = skip(at)
        mark = text[at]
        if mark == ",":
            at += 1
        elif in_object and mark == "}":
            number, fields, _ = open_.pop()
            if number >= 0:
                nodes.append((number, open_[-1][0], len(open_) - 1, fields))
            at, in_object = at + 1, False
        elif in_object:
            if mark != '"':
                raise ValueError(f"no key at {at}")
            key, at = scanstring(text, at + 1)
            at = skip(at)
            if text[at] != ":":
                raise ValueError(f"no value at {at}")
            at = skip(at + 1)
            if key in open_[-1][2] and text[at] == "[":
                at, in_object = at + 1, False
            else:
                open_[-1][1][key], at = decode(text, at)
        elif mark == "]":
            at, in_object = at + 1, True
        elif mark == "{":
            open_.append((count, {}, ("children",)))
            at, in_object, count = at + 1, True, count + 1
        else:
            _, at = decode(text, at)
    return head, nodes


_NODES = "node bigint, parent bigint, depth int, message_id string, parent_message string, sender string, text string, created string, empty boolean, title string, recursive boolean"


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def document_rows(documents: DataFrame, doc: str, json_column: str) -> DataFrame:
    """A row per message of each export and one (node -1) for its head; a document that is not JSON gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    head, nodes = document_nodes(batch.column(1)[i].as_py() or "")
                except (ValueError, IndexError):
                    continue
                recursive = bool(head.get("recursive", True))
                rows = [(-1, -2, -1, None, None, None, None, None, False, _text(head.get("title")), recursive)]
                for node, parent, depth, m in nodes:
                    empty = not m.get("text") and not m.get("content")
                    fields = (_text(m.get(k)) or None for k in ("messageId", "parentMessageId", "sender", "text", "createdAt"))
                    rows.append((node, parent, depth, *fields, empty, None, recursive))
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    ids = pa.array([batch.column(0)[i].as_py()] * len(part), batch.column(0).type)
                    columns = [pa.array(c, k) for c, k in zip(zip(*part, strict=True), _KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=[doc, *_NAMES])

    kind = documents.schema[doc].dataType.simpleString()
    return documents.select(doc, json_column).mapInArrow(run, f"{doc} {kind}, {_NODES}")


_NAMES = [c.split()[0] for c in _NODES.split(", ")]
_KINDS = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in _NODES.split(", ")]


def import_tree(documents: DataFrame, doc: str, json: str, title: str = "Imported Chat") -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of own exports, nested (``recursive``, also where they do not say) or linear.

    Conversations: (doc, title, created_at), with the first date in document order among the messages kept, null without
    any. Messages: (doc, node, depth, message_id, parent_id, sender, text, created_at). In a nested export an empty
    message goes with all below it and the nesting tells the parent; a linear one names the parents itself.
    """
    rows = cut_lineage(document_rows(documents, doc, json))
    nodes = rows.filter("node >= 0")
    forest = nodes.select(F.col(doc).alias("conv_id"), F.col("node").alias("msg"), "parent", "empty")
    lost = fold_to_root(forest, {"lost": ("max", F.col("empty").cast("int"))}).filter("lost = 1")
    lost = lost.select(F.col("conv_id").alias(doc), F.col("msg").alias("node"))
    kept = nodes.filter("recursive").join(lost, [doc, "node"], "left_anti").unionByName(nodes.filter("NOT recursive"))
    above = nodes.select(doc, F.col("node").alias("parent"), F.col("message_id").alias("_above"))
    parent = F.when(F.col("recursive"), F.col("_above")).otherwise(F.col("parent_message"))
    messages = kept.join(above, [doc, "parent"], "left").select(
        doc, "node", "depth", "message_id", F.coalesce(parent, F.lit(NO_PARENT)).alias("parent_id"), "sender", "text", F.to_timestamp_ntz("created").alias("created_at")
    )
    messages = cut_lineage(messages)
    dates = messages.filter("created_at IS NOT NULL").groupBy(doc).agg(F.min_by("created_at", "node").alias("created_at"))
    heads = rows.filter("node = -1").select(doc, F.coalesce(F.nullif("title", F.lit("")), F.lit(title)).alias("title"))
    return heads.join(dates, doc, "left"), messages
