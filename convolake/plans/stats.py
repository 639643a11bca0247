"""Aggregations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.text import token_estimate
from convolake.operators import joins as J
from convolake.operators import fragments as Fr
from convolake.operators import scan
from convolake.plans.registry import query
from convolake.sources.tables import MSG_SQL, USAGE_SQL


@query(
    "a1_user_activity",
    """SELECT c_custkey, c_name, coalesce(n_conversations, 0) AS n_conversations, coalesce(n_messages, 0) AS n_messages
       FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS n_conversations FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
       LEFT JOIN (SELECT o_custkey, count(*) AS n_messages FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l
       ON l.o_custkey = c_custkey""",
)
def _(t):
    # one pass over each fact table: messages per conversation first, then both counts per user together
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    counts = (
        t.orders.select("o_orderkey", "o_custkey")
        .join(per_order, "o_orderkey", "left")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_conversations"), F.sum(F.coalesce("n", F.lit(0))).alias("n_messages"))
    )
    return (
        t.customer.select("c_custkey", "c_name")
        .join(counts, "c_custkey", "left")
        .fillna(0, ["n_conversations", "n_messages"])
        .orderBy(F.desc("n_conversations"), F.desc("n_messages"), "c_custkey")
    )


@query(
    "a2_group_count",
    """SELECT kind, count(*) AS n FROM (SELECT nullif(event_type, 'view') AS kind FROM events)
       WHERE kind IS NOT NULL GROUP BY kind""",
)
def _(t):
    kinds = t.events.select(F.nullif("event_type", F.lit("view")).alias("kind"))
    return kinds.filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "a3_filtered_counts",
    """SELECT count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'purchase' AND value > 100) AS promoted,
              count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS active_sessions FROM events""",
)
def _(t):
    return t.events.agg(
        F.countDistinct("user_id").alias("users"),
        F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("promoted"),
        F.count_if(F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")).alias("active_sessions"),
    )


@query("a4_distinct_values", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").distinct()


@query(
    "a5_bit_or",
    "SELECT o_custkey AS user_id, CAST(bit_or(CAST(o_orderkey % 16 AS INTEGER)) AS INTEGER) AS bits FROM orders GROUP BY 1",
)
def _(t):
    return t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.bit_or((F.col("o_orderkey") % 16).cast("int")).alias("bits")
    )


@query(
    "a6_has_permission",
    """SELECT o_custkey AS user_id, bool_or((o_orderkey % 16) & 6 = 6) AS allowed,
              bool_or(o_orderstatus = 'P' AND (o_orderkey % 16) & 1 = 1) AS public_view FROM orders GROUP BY 1""",
)
def _(t):
    bits = F.col("o_orderkey") % 16
    return t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.bool_or(bits.bitwiseAND(F.lit(6)) == 6).alias("allowed"),
        F.bool_or((F.col("o_orderstatus") == "P") & (bits.bitwiseAND(F.lit(1)) == 1)).alias("public_view"),
    )


@query(
    "a7_one_per_category",
    """SELECT p_type, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC,
       p_partkey) AS rn FROM part) WHERE rn = 1""",
)
def _(t):
    first = F.min_by(F.struct("p_partkey", "p_name"), F.struct(-F.col("p_retailprice"), F.col("p_partkey")))
    return t.part.groupBy("p_type").agg(first.alias("r")).select("p_type", "r.*")


@query(
    "a8_page_count",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 30.0) AS BIGINT) AS pages FROM part WHERE p_size > 20",
)
def _(t):
    return t.part.filter("p_size > 20").agg(
        F.count("*").alias("total"), F.ceil(F.count("*") / 30.0).cast("bigint").alias("pages")
    )


@query(
    "a9_knowledge_stats",
    """SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(DISTINCT source) FROM documents) AS n_sources,
              (SELECT max(len(embedding)) FROM embeddings) AS dimension""",
)
def _(t):
    d = t.documents.agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"))
    e = t.embeddings.agg(F.max(F.size("embedding")).alias("dimension"))
    # both sides are one-row aggregates
    return d.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k")


_PROGRESS = """SELECT count(*) AS total, count(l.doc_id) AS indexed FROM documents d LEFT JOIN labels l USING (doc_id)"""


def progress(t):
    return J.flagged(t.documents.select("doc_id"), t.labels, "doc_id", "done").agg(
        F.count("*").alias("total"), F.count_if("done").alias("indexed")
    )


@query("a10_sync_progress", f"SELECT total, indexed, total = indexed AS complete FROM ({_PROGRESS})")
def _(t):
    return progress(t).withColumn("complete", F.col("total") == F.col("indexed"))


@query(
    "a11_sync_decision",
    f"""SELECT total - indexed AS pending, CASE WHEN total = indexed THEN 'none' WHEN total - indexed > 1000 THEN 'full'
        ELSE 'incremental' END AS decision FROM ({_PROGRESS})""",
)
def _(t):
    from convolake.functions.fixed import SYNC_THRESHOLD

    pending = F.col("total") - F.col("indexed")
    return progress(t).select(
        pending.alias("pending"),
        F.when(pending == 0, "none").when(pending > SYNC_THRESHOLD, "full").otherwise("incremental").alias("decision"),
    )


@query(
    "a12_ingest_report",
    """SELECT lang AS content_type, n_chars < 200 AS ocr, count(*) AS chunks, sum(n_chars) AS chars FROM documents
       GROUP BY ALL""",
)
def _(t):
    return t.documents.groupBy(F.col("lang").alias("content_type"), (F.col("n_chars") < 200).alias("ocr")).agg(
        F.count("*").alias("chunks"), F.sum("n_chars").alias("chars")
    )


@query(
    "a13_memory_digest",
    f"""WITH {MSG_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at, msg) AS i FROM msg),
        tot AS (SELECT conv_id, sum(tokens) AS total FROM msg GROUP BY conv_id)
        SELECT conv_id, total AS total_tokens, least(100, round(total * 100 / 500.0)) AS usage_pct,
          string_agg(i || '. [' || strftime(created_at, '%Y-%m-%d') || ']. ' || text, E'\\n\\n' ORDER BY i) AS without_keys,
          string_agg(i || '. [' || strftime(created_at, '%Y-%m-%d') || ']. ["key": "' || role || '"] ["tokens": ' || tokens
            || ']' || text, E'\\n\\n' ORDER BY i) AS with_keys
        FROM n JOIN tot USING (conv_id) GROUP BY conv_id, total""",
)
def _(t):
    m = t.messages()
    totals = m.groupBy("conv_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("total_tokens"))
    rows = scan.with_number(m, ["conv_id"], ["created_at", "msg"], F.date_trunc("hour", "created_at"), "i")
    lead = F.concat(F.col("i").cast("string"), F.lit(". ["), F.date_format("created_at", "yyyy-MM-dd"), F.lit("]. "))
    keyed = F.concat(
        lead, F.lit('["key": "'), "role", F.lit('"] ["tokens": '), F.col("tokens").cast("string"), F.lit("]"), "text"
    )
    position = (F.col("i") - 1).alias("position")

    def digest(line, name):
        parts = rows.select("conv_id", position, line.alias("fragment"))
        return Fr.whole(parts, ["conv_id"], "\n\n").select("conv_id", F.col("value").alias(name))

    used = F.least(F.lit(100.0), F.round(F.col("total_tokens") * 100 / 500.0)).alias("usage_pct")
    return (
        totals.select("conv_id", "total_tokens", used)
        .join(digest(F.concat(lead, "text"), "without_keys"), "conv_id")
        .join(digest(keyed, "with_keys"), "conv_id")
    )


@query(
    "a15_grouped_lists",
    """SELECT l_orderkey, count(*) AS n, string_agg(l_partkey || 'x' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)
       AS items FROM lineitem GROUP BY l_orderkey""",
)
def _(t):
    value = F.concat(F.col("l_partkey").cast("string"), F.lit("x"), F.col("l_quantity").cast("bigint").cast("string"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    parts = Fr.fragments(t.lineitem.select("l_orderkey", *order), ["l_orderkey"], order, F.col("l_linenumber"), value)
    return Fr.whole(parts, ["l_orderkey"], ",").select("l_orderkey", "n", F.col("value").alias("items"))


@query(
    "a16_spend_rollup",
    f"""WITH {USAGE_SQL} SELECT model, context, grouping(model) + grouping(context) AS level, count(*) AS n,
        sum(prompt_tokens) AS raw_amount, round(sum(prompt_tokens * 1.5 + completion_tokens * 2), 2) AS token_value
        FROM usage GROUP BY ROLLUP (model, context)""",
)
def _(t):
    value = F.col("prompt_tokens") * 1.5 + F.col("completion_tokens") * 2
    return (
        t.usage()
        .rollup("model", "context")
        .agg(
            (F.grouping("model") + F.grouping("context")).cast("int").alias("level"),
            F.count("*").alias("n"),
            F.sum("prompt_tokens").alias("raw_amount"),
            F.round(F.sum(value), 2).alias("token_value"),
        )
    )


@query(
    "a18_next_position",
    """SELECT conv_id, coalesce(max(turn) FILTER (role = 'assistant'), 0) + 1 AS next_position FROM conversations GROUP BY 1""",
)
def _(t):
    stored = F.max(F.when(F.col("role") == "assistant", F.col("turn")))
    return t.conversations.groupBy("conv_id").agg((F.coalesce(stored, F.lit(0)) + 1).alias("next_position"))


@query(
    "a19_feedback",
    """SELECT lang, count(*) FILTER (quality = 1) AS "thumbsUp", count(*) FILTER (quality = 0) AS "thumbsDown",
              count(*) FILTER (toxic = 1) AS tagged FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def _(t):
    return (
        t.documents.select("doc_id", "lang")
        .join(t.labels, "doc_id")
        .groupBy("lang")
        .agg(
            F.count_if(F.col("quality") == 1).alias("thumbsUp"),
            F.count_if(F.col("quality") == 0).alias("thumbsDown"),
            F.count_if(F.col("toxic") == 1).alias("tagged"),
        )
    )


_PAGES = """SELECT l_partkey, page, max(l_discount) AS top, arg_max(l_discount, (l_orderkey, l_suppkey, l_discount)) AS latest
            FROM (SELECT *, l_linenumber AS page FROM lineitem) GROUP BY ALL"""


@query(
    "a20_sources_per_file",
    f"""SELECT l_partkey AS file_id, string_agg(page, ',' ORDER BY page) AS pages, max(top) AS relevance,
         string_agg(page || ':' || round(latest, 2), ',' ORDER BY page) AS page_relevance FROM ({_PAGES}) GROUP BY 1""",
)
def _(t):
    # pages of a file are few; the rows behind them are reduced to one per page before any list is built
    pages = t.lineitem.groupBy("l_partkey", F.col("l_linenumber").alias("page")).agg(
        F.max("l_discount").alias("top"),
        F.max_by("l_discount", F.struct("l_orderkey", "l_suppkey", "l_discount")).alias("latest"),
    )
    rows = (
        pages.groupBy(F.col("l_partkey").alias("file_id"))
        .agg(
            F.max("top").alias("relevance"),
            F.array_sort(F.collect_list(F.struct("page", F.round("latest", 2).alias("r")))).alias("p"),
        )
    )
    return rows.select(
        "file_id",
        F.array_join(F.transform("p", lambda x: x["page"].cast("string")), ",").alias("pages"),
        "relevance",
        F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["page"], x["r"])), ",").alias("page_relevance"),
    )


@query(
    "a21_resource_buckets",
    """SELECT bucket, count(DISTINCT source || '/' || lang) AS n_files, min(doc_id) AS first_doc FROM (
         SELECT *, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'execute_code' WHEN n_chars > 2000 THEN 'file_search'
           WHEN lang <> 'en' THEN 'image_edit' END AS bucket FROM documents) WHERE bucket IS NOT NULL GROUP BY bucket""",
)
def _(t):
    bucket = (
        F.when(F.col("text").rlike("[0-9]{4}"), "execute_code")
        .when(F.col("n_chars") > 2000, "file_search")
        .when(F.col("lang") != "en", "image_edit")
    )
    files = (
        t.documents.select("doc_id", bucket.alias("bucket"), F.concat_ws("/", "source", "lang").alias("file"))
        .filter("bucket IS NOT NULL")
        .groupBy("bucket", "file")
        .agg(F.min("doc_id").alias("first_doc"))
    )
    return files.groupBy("bucket").agg(F.count("*").alias("n_files"), F.min("first_doc").alias("first_doc"))


@query(
    "a22_attachments_by_call",
    """SELECT l_orderkey AS message, l_linenumber AS part, l_returnflag AS tool, count(*) AS n_calls,
         string_agg(l_partkey, ',' ORDER BY l_partkey, l_suppkey) AS attachments
       FROM lineitem GROUP BY ALL""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("message"),
        F.col("l_linenumber").alias("part"),
        F.col("l_returnflag").alias("tool"),
        "l_partkey",
        "l_suppkey",
    )
    keys = ["message", "part", "tool"]
    lists = Fr.joined(rows, keys, ["l_partkey", "l_suppkey"], F.col("l_partkey").cast("string"), ",")
    return lists.select(*keys, F.col("n").alias("n_calls"), F.col("value").alias("attachments"))
