"""Exports and imports of whole conversations, however long and deep."""

import json

from pyspark.sql import functions as F

from convolake.operators import fragments
from convolake.sources import exports as E
from convolake.sources import imports as I

SHAPE = "conv_id bigint, msg bigint, parent bigint, role string, text string, created_at timestamp_ntz"


def messages(spark, rows):
    df = spark.createDataFrame([(c, m, p, r, t, m) for c, m, p, r, t in rows], SHAPE.replace("created_at timestamp_ntz", "s bigint"))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return df.withColumn("created_at", start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)"))).drop("s")


def test_long_chain_keeps_every_parent(spark):
    """5 000 messages, each the child of the one before; and a wide tree."""
    chain = [(1, i, i - 1, "user", f'say "{i}"\n') for i in range(5000)]
    wide = [(2, 0, -1, "user", "root")] + [(2, i, 0 if i % 2 else i - 1, "user", str(i)) for i in range(1, 400)] + [(2, 900, -1, "user", "second root")]
    docs = E.nested_documents(messages(spark, chain + wide), F.lit('a "title"')).select(F.col("conv_id").alias("doc"), "n", "json")
    assert {r.doc: r.n for r in docs.collect()} == {1: 5000, 2: 401}
    heads, found = I.import_tree(docs, "doc", "json")
    got = {(r.doc, r.message_id): (r.parent_id, r.text) for r in found.collect()}
    assert got == {(c, str(m)): (I.NO_PARENT if p < 0 else str(p), t) for c, m, p, _, t in chain + wide}
    assert {(r.doc, r.title, str(r.created_at)) for r in heads.collect()} == {(c, 'a "title"', "2024-01-01 00:00:00") for c in (1, 2)}


def test_fragments_join_to_json(spark):
    rows = [(7, 0, -1, "user", "é"), (7, 1, 0, "bot", ""), (7, 2, 1, "bot", "x"), (7, 3, 0, "bot", None), (7, 4, -1, "user", "y")]
    parts = E.nested_fragments(messages(spark, rows), E.message_head())
    text = "[" + "".join(r.fragment for r in fragments.in_order(parts, ["conv_id"]).collect()) + "]"
    tree = json.loads(text)
    ids = lambda items: [(m["messageId"], ids(m["children"])) for m in items]
    assert ids(tree) == [("0", [("1", [("2", [])]), ("3", [])]), ("4", [])]
    assert "text" not in tree[0]["children"][1] and tree[0]["createdAt"] == "2024-01-01T00:00:00.000Z"


def test_documents_of_all_kinds(spark):
    linear = {"conversationId": "c", "recursive": False, "messages": [{"messageId": "a", "text": "1"}, {"messageId": "b", "text": "", "parentMessageId": "a", "createdAt": "2024-05-01T10:00:00.000Z"}]}
    late = '{"messagesTree":[{"children":[{"children":[],"text":"in","messageId":"2"}, null, 5],"content":[{"type":"text"}],"messageId":"1"}],"title":"T","x":{"messages":[1]}}'
    docs = [("linear", json.dumps(linear)), ("late", late), ("bad", "{bad"), ("cut", '{"messagesTree":[{"messageId":"1"'), ("none", None), ("empty", "{}"), ("array", "[1]")]
    heads, found = I.import_tree(spark.createDataFrame([(d, j, "z") for d, j in docs], "doc string, json string, node string"), "doc", "json")
    got = sorted((r.doc, r.message_id, r.parent_id, r.text) for r in found.collect())
    assert got == sorted([("linear", "a", I.NO_PARENT, "1"), ("linear", "b", "a", None), ("late", "1", I.NO_PARENT, None), ("late", "2", "1", "in")], key=lambda r: r[:3])
    assert {r.doc: (r.title, r.created_at and r.created_at.isoformat()) for r in heads.collect()} == {
        "linear": ("Imported Chat", "2024-05-01T10:00:00"), "late": ("T", None), "empty": ("Imported Chat", None),
    }


def test_no_messages(spark):
    assert E.nested_documents(messages(spark, []), F.lit("t")).count() == 0
    heads, found = I.import_tree(spark.createDataFrame([], "doc bigint, json string"), "doc", "json")
    assert heads.count() == found.count() == 0
