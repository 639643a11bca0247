"""Filters and projections over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import predicates as P
from convolake.plans.registry import query
from convolake.sources.tables import MSG_SQL


@query(
    "f1_equality_lookup",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 899 AND o_orderstatus = 'P'",
)
def _(t):
    return t.orders.filter(P.all_equal(o_custkey=899, o_orderstatus="P")).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(
    "f2_null_or_empty",
    """SELECT event_id, kind FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN ''
       WHEN event_type <> 'error' THEN event_type END AS kind FROM events) WHERE kind IS NULL OR kind = ''""",
)
def _(t):
    kind = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "error", F.col("event_type"))
    return t.events.select("event_id", kind.alias("kind")).filter(P.null_or_empty("kind"))


@query("f3_projection", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return t.customer.drop("c_acctbal")


@query(
    "f4_set_membership",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
       (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def _(t):
    wanted = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return (
        t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .join(wanted, "o_custkey", "left_semi")
        .select("o_orderkey", "o_custkey")
    )


@query("f5_tags_any", "SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['fr', 'src3', 'src7'])")
def _(t):
    tags = F.array("lang", "source")
    return t.documents.filter(F.arrays_overlap(tags, F.array(*map(F.lit, ["fr", "src3", "src7"])))).select("doc_id")


@query(
    "f6_contains_search",
    """SELECT p_partkey, p_name, p_brand FROM part
       WHERE contains(lower(p_name), 'red wid') OR contains(lower(p_brand), '#2')""",
)
def _(t):
    hit = P.any_of([P.any_contains(["p_name"], "Red WID"), P.any_contains(["p_brand"], "#2")])
    return t.part.filter(hit).select("p_partkey", "p_name", "p_brand")


@query(
    "f7_regex_search",
    """SELECT doc_id, 0.8 AS score FROM documents
       WHERE regexp_matches(text, '(?i)th(e|is) .*ing') OR regexp_matches(source, '(?i)th(e|is) .*ing')
       ORDER BY doc_id LIMIT 25""",
)
def _(t):
    hit = P.any_matches(["text", "source"], "th(e|is) .*ing")
    return t.documents.filter(hit).select("doc_id", F.lit(0.8).alias("score")).orderBy("doc_id").limit(25)


@query(
    "f8_bits_all_set",
    "SELECT o_orderkey, o_orderkey % 16 AS bits FROM orders WHERE (o_orderkey % 16) & 5 = 5",
)
def _(t):
    return t.orders.select("o_orderkey", (F.col("o_orderkey") % 16).alias("bits")).filter(P.has_bits("bits", 5))


_EXPIRING = """SELECT event_id, CASE event_type WHEN 'view' THEN ts + INTERVAL 1 HOUR WHEN 'click' THEN ts + INTERVAL 30 DAY
               END AS expires_at FROM events"""


def expiring(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        F.when(F.col("event_type") == "view", ts + F.expr("INTERVAL 1 HOUR"))
        .when(F.col("event_type") == "click", ts + F.expr("INTERVAL 30 DAY"))
        .alias("expires_at"),
    )


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


@query(
    "f9_live_rows",
    f"SELECT event_id, expires_at IS NULL AS permanent FROM ({_EXPIRING}) "
    "WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20'",
)
def _(t):
    return (
        expiring(t)
        .filter(P.visible_at("expires_at", now()))
        .select("event_id", P.live("expires_at").alias("permanent"))
    )


@query(
    "f10_flag_false_or_missing",
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)
       WHERE coalesce(l.toxic = 1, FALSE) = FALSE""",
)
def _(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return joined.filter(P.flag_is(F.col("toxic") == 1, False)).select("doc_id")


@query(
    "f11_valid_interval",
    """SELECT event_id, event_type FROM (SELECT event_id, event_type, user_id, ts AS starts,
         CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 2 DAY END AS ends FROM events)
       WHERE starts <= TIMESTAMP '2024-01-20' AND (ends IS NULL OR ends >= TIMESTAMP '2024-01-20')
         AND (event_type = 'view' OR user_id = 8 OR ends IS NULL)""",
)
def _(t):
    starts = F.col("ts")
    ends = F.when(F.col("event_type") != "signup", starts + F.expr("INTERVAL 2 DAY"))
    seen = P.any_of([F.col("event_type") == "view", F.col("user_id") == 8, ends.isNull()])
    return t.events.filter(P.valid_at(starts, ends, now()) & seen).select("event_id", "event_type")


@query(
    "f12_capability_files",
    """SELECT doc_id FROM documents WHERE (length(text) > 5000 AND lang = 'en') OR source = 'src3'
       OR regexp_matches(text, '[0-9]{4}')""",
)
def _(t):
    wanted = {
        "file_text": (F.length("text") > 5000) & (F.col("lang") == "en"),
        "embedded": F.col("source") == "src3",
        "code": F.col("text").rlike("[0-9]{4}"),
    }
    return t.documents.filter(P.any_of(list(wanted.values()))).select("doc_id")


@query(
    "f13_category_listing",
    """SELECT p_partkey, 'my' AS listing FROM part WHERE p_size = 7
       UNION ALL SELECT p_partkey, 'shared' FROM part WHERE p_size <> 7
       UNION ALL SELECT p_partkey, 'none' FROM part WHERE nullif(p_type, 'PROMO') IS NULL
       UNION ALL SELECT p_partkey, 'LARGE' FROM part WHERE p_type = 'LARGE'""",
)
def _(t):
    part = t.part.select("p_partkey", "p_size", F.nullif("p_type", F.lit("PROMO")).alias("category"))
    frames = [
        part.filter(P.category_filter(w, "category", F.col("p_size"), 7)).select(
            "p_partkey", F.lit(w).alias("listing")
        )
        for w in ("my", "shared", "none", "LARGE")
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query(
    "f14_own_or_shared",
    """SELECT p_partkey, CASE WHEN p_size = 7 THEN p_size END AS author, g.l_partkey IS NOT NULL AS shared
       FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 50) g ON l_partkey = p_partkey
       WHERE p_size = 7 OR g.l_partkey IS NOT NULL""",
)
def _(t):
    shared = (
        t.lineitem.filter("l_quantity >= 50")
        .select(F.col("l_partkey").alias("p_partkey"))
        .distinct()
        .withColumn("shared", F.lit(True))
    )
    mine = F.col("p_size") == 7
    return (
        t.part.select("p_partkey", "p_size")
        .join(shared, "p_partkey", "left")
        .filter(mine | F.col("shared").isNotNull())
        .select("p_partkey", F.when(mine, F.col("p_size")).alias("author"), F.col("shared").isNotNull().alias("shared"))
    )


_UUID_OF = """CASE WHEN doc_id % 7 = 0 THEN 'conv-' || doc_id ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' ||
  substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END"""


@query(
    "f15_uuid_guard",
    f"""SELECT doc_id, key, CASE WHEN regexp_matches(key, '{P.UUID}') THEN 'valid' ELSE 'rejected' END AS verdict
        FROM (SELECT doc_id, {_UUID_OF} AS key FROM (SELECT doc_id, md5(text) AS h FROM documents))""",
)
def _(t):
    h = F.col("h")
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    key = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("conv-"), F.col("doc_id").cast("string"))).otherwise(
        F.concat_ws("-", *parts)
    )
    return (
        t.documents.select("doc_id", F.md5("text").alias("h"))
        .select("doc_id", key.alias("key"))
        .withColumn("verdict", F.when(F.col("key").rlike(P.UUID), "valid").otherwise("rejected"))
    )


@query(
    "f16_nan_reset",
    """SELECT event_id, CASE WHEN isnan(v) THEN 0 ELSE v END AS token_count FROM (
         SELECT event_id, event_type, CASE WHEN value > 400 THEN 'nan'::DOUBLE ELSE value END AS v FROM events)
       WHERE NOT (isnan(v) AND event_type = 'purchase')""",
)
def _(t):
    v = F.when(F.col("value") > 400, F.lit(float("nan"))).otherwise(F.col("value"))
    return (
        t.events.select("event_id", "event_type", v.alias("v"))
        .filter(~(F.isnan("v") & (F.col("event_type") == "purchase")))
        .select("event_id", F.when(F.isnan("v"), F.lit(0.0)).otherwise(F.col("v")).alias("token_count"))
    )


@query(
    "f17_domain_checks",
    """SELECT rule, n_bad FROM (SELECT
         count(*) FILTER (NOT regexp_matches(lower(c_name), '^[a-z0-9-]+$')) AS command,
         count(*) FILTER (NOT (regexp_matches(lower(c_mktsegment), '^[a-z_]+$') AND lower(c_mktsegment) <> 'nothing'))
           AS memory_key,
         count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS segment,
         count(*) FILTER (NOT regexp_matches(c_name || '@example.com', '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')) AS email,
         count(*) - count(DISTINCT c_custkey) AS unique_key
       FROM customer) UNPIVOT (n_bad FOR rule IN (command, memory_key, segment, email, unique_key))""",
)
def _(t):
    key = F.lower("c_mktsegment")
    rules = {
        "command": F.lower("c_name").rlike("^[a-z0-9-]+$"),
        "memory_key": key.rlike("^[a-z_]+$") & (key != "nothing"),
        "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"),
        "email": F.concat("c_name", F.lit("@example.com")).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
    }
    repeats = (
        t.customer.groupBy("c_custkey")
        .count()
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n_bad"))
        .select(F.lit("unique_key").alias("rule"), "n_bad")
    )
    return P.violations(t.customer, rules).unionByName(repeats)


@query(
    "f18_index_document",
    """SELECT replace(conv_id || '|' || turn, '|', '--') AS id, text, role AS sender, conv_id AS conversation_id,
              replace(replace(conv_id || '|' || turn, '|', '--'), '--', '|') AS source_id FROM conversations""",
)
def _(t):
    key = F.concat_ws("|", "conv_id", "turn")
    indexed = F.regexp_replace(key, r"\|", "--")
    return t.conversations.select(
        indexed.alias("id"),
        "text",
        F.col("role").alias("sender"),
        F.col("conv_id").alias("conversation_id"),
        F.regexp_replace(indexed, "--", "|").alias("source_id"),
    )


@query(
    "f19_changed_titles",
    """SELECT d.doc_id, d.text AS title FROM documents d
       LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN text ELSE lower(text) END AS title
                  FROM labels JOIN documents USING (doc_id)) i USING (doc_id)
       WHERE d.n_chars > 100 AND d.text IS DISTINCT FROM i.title""",
)
def _(t):
    docs = t.documents.filter("n_chars > 100").select("doc_id", F.col("text").alias("title"))
    index = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lower("text")).alias("indexed"),
    )
    return (
        docs.join(index, "doc_id", "left")
        .filter(~F.col("title").eqNullSafe(F.col("indexed")))
        .select("doc_id", "title")
    )


@query(
    "f20_model_list",
    """SELECT p_partkey, p_name, contains(p_name, 'ring') AS last_group FROM part
       WHERE regexp_matches(p_name, '(red|small|ring)') AND NOT regexp_matches(p_name, '(widget|gear)')
       ORDER BY last_group, p_partkey""",
)
def _(t):
    name = F.col("p_name")
    return (
        t.part.filter(name.rlike("(red|small|ring)") & ~name.rlike("(widget|gear)"))
        .select("p_partkey", "p_name", name.contains("ring").alias("last_group"))
        .orderBy("last_group", "p_partkey")
    )


@query(
    "s18_collection_scan",
    "SELECT event_id, ts, user_id FROM events ORDER BY ts, event_id",
)
def _(t):
    return t.events.select("event_id", "ts", "user_id").orderBy("ts", "event_id")


@query(
    "w8_last_user_message",
    f"WITH {MSG_SQL} SELECT conv_id, arg_max(msg, msg) AS msg, arg_max(text, msg) AS text FROM msg "
    "WHERE role = 'user' GROUP BY conv_id",
)
def _(t):
    return (
        t.messages()
        .filter("role = 'user'")
        .groupBy("conv_id")
        .agg(F.max_by(F.struct("msg", "text"), "msg").alias("m"))
        .select("conv_id", "m.msg", "m.text")
    )
