"""Sorting, limits and pages over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import paging as P
from convolake.operators import scan
from convolake.plans.registry import query

AFTER = ("1998-06-01 00:00:00", 5000)
_PAGE = """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'
  OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey > 5000) ORDER BY o_orderdate DESC, o_orderkey"""


def orders_page(t, limit):
    return P.keyset_page(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "o_orderkey", limit, AFTER)


@query("k1_keyset_page", f"{_PAGE} LIMIT 26")
def _(t):
    return orders_page(t, 25)


@query(
    "k2_compound_cursor",
    f"""SELECT position, TRUE AS has_more, o_orderkey, o_orderdate, o_totalprice,
          to_base64(encode('{{"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","o_orderkey":' || o_orderkey
          || '}}')) AS cursor
        FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position FROM ({_PAGE} LIMIT 21))
        WHERE position < 20""",
)
def _(t):
    limit = P.clamp_limit(None)
    return P.page_with_cursor(orders_page(t, limit), "o_orderdate", "o_orderkey", limit)


@query(
    "k3_offset_page",
    "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 100",
)
def _(t):
    rows = t.part.select("p_partkey", "p_name", "p_retailprice")
    return P.offset_page(rows, [F.desc("p_retailprice"), F.asc("p_partkey")], 3, 50)


@query(
    "k7_relevance_search",
    """SELECT c_custkey, c_name, c_mktsegment, greatest(
         CASE WHEN lower(c_name) = 'ma' THEN 100 WHEN starts_with(lower(c_name), 'ma') THEN 80
              WHEN contains(lower(c_name), 'ma') THEN 50 ELSE 10 END,
         CASE WHEN lower(c_mktsegment) = 'ma' THEN 100 WHEN starts_with(lower(c_mktsegment), 'ma') THEN 80
              WHEN contains(lower(c_mktsegment), 'ma') THEN 50 ELSE 10 END) AS score
       FROM customer WHERE contains(lower(c_name), 'ma') OR contains(lower(c_mktsegment), 'ma')
       ORDER BY score DESC, c_custkey LIMIT 20""",
)
def _(t):
    from convolake.operators.predicates import any_contains

    columns = ["c_name", "c_mktsegment"]
    return (
        t.customer.filter(any_contains(columns, "MA"))
        .select("c_custkey", *columns, P.relevance(columns, "MA").alias("score"))
        .orderBy(F.desc("score"), "c_custkey")
        .limit(20)
    )


def principals(t):
    users = t.customer.select(F.lit("user").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    groups = t.supplier.select(F.lit("group").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    roles = t.nation.select(
        F.lit("role").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")
    )
    return users, groups, roles


_PRINCIPALS = """pri AS (SELECT 'user' AS kind, c_custkey AS id, c_name AS name FROM customer
  UNION ALL SELECT 'group', s_suppkey, s_name FROM supplier UNION ALL SELECT 'role', n_nationkey, n_name FROM nation),
hit AS (SELECT *, CASE WHEN lower(name) = '1' THEN 100 WHEN starts_with(lower(name), '1') THEN 80 ELSE 50 END AS score
        FROM pri WHERE contains(lower(name), '1'))"""


@query(
    "k8_principal_order",
    f"WITH {_PRINCIPALS} SELECT kind, id, name, score FROM hit ORDER BY score DESC, kind <> 'user', name, id LIMIT 100",
)
def _(t):
    users, groups, roles = principals(t)
    hits = users.unionByName(groups).unionByName(roles).filter(F.lower("name").contains("1"))
    return (
        hits.withColumn("score", P.relevance(["name"], "1"))
        .orderBy(F.desc("score"), F.col("kind") != "user", F.coalesce("name", F.lit("")), "id")
        .limit(100)
    )


@query(
    "k9_principal_search",
    f"""WITH {_PRINCIPALS} SELECT kind, id, name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC,
        name, id) AS rn FROM hit) WHERE rn <= 10""",
)
def _(t):
    frames = [
        f.filter(F.lower("name").contains("1"))
        .withColumn("score", P.relevance(["name"], "1"))
        .orderBy(F.desc("score"), "name", "id")
        .limit(10)
        .drop("score")
        for f in principals(t)
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "k10_missing_last",
    """SELECT o_orderkey, ord, o_orderdate FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 5 END AS ord
       FROM orders) ORDER BY ord ASC NULLS LAST, o_orderdate DESC, o_orderkey""",
)
def _(t):
    ord_ = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 5)
    return t.orders.select("o_orderkey", ord_.alias("ord"), "o_orderdate").orderBy(
        F.col("ord").asc_nulls_last(), F.col("o_orderdate").desc(), "o_orderkey"
    )


@query("k11_random_sample")
def _(t):
    return t.part.select("p_partkey", "p_type").orderBy(F.rand(42), "p_partkey").offset(5).limit(20)


@query(
    "k12_date_buckets",
    """WITH e AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN ts - INTERVAL 400 DAY WHEN event_type = 'error'
         THEN ts - INTERVAL 2 MONTH ELSE ts END AS ts, TIMESTAMP '2024-01-31 12:00:00' AS n FROM events),
       b AS (SELECT event_id, ts, n, CASE WHEN date_trunc('day', ts) = date_trunc('day', n) THEN 'Today'
         WHEN ts >= date_trunc('day', n - INTERVAL 1 DAY) AND ts <= n THEN 'Yesterday'
         WHEN ts >= date_trunc('day', n - INTERVAL 7 DAY) AND ts <= n THEN 'Previous 7 days'
         WHEN ts >= date_trunc('day', n - INTERVAL 30 DAY) AND ts <= n THEN 'Previous 30 days'
         WHEN year(ts) = year(n) THEN strftime(ts, '%B') ELSE ' ' || year(ts) END AS label FROM e)
       SELECT event_id, label, CASE label WHEN 'Today' THEN 0 WHEN 'Yesterday' THEN 1 WHEN 'Previous 7 days' THEN 2
         WHEN 'Previous 30 days' THEN 3 ELSE CASE WHEN year(ts) = year(n) THEN 20 - month(ts) ELSE 10000 - year(ts) END END AS rank
       FROM b""",
)
def _(t):
    kind, ts = F.col("event_type"), F.col("ts")
    moved = (
        F.when(kind == "signup", ts - F.expr("INTERVAL 400 DAY"))
        .when(kind == "error", ts - F.expr("INTERVAL 2 MONTH"))
        .otherwise(ts)
    )
    now = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    return (
        t.events.select("event_id", moved.alias("ts"))
        .select("event_id", "ts", P.date_bucket(F.col("ts"), now).alias("b"))
        .orderBy("b.rank", F.desc("ts"), "event_id")
        .select("event_id", "b.label", "b.rank")
    )


@query(
    "k13_repaginate",
    """SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 25 AS page, o_custkey, o_orderkey FROM (
         SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey)""",
)
def _(t):
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    numbered = scan.with_number(first, [], ["o_orderkey"], F.floor(F.col("o_orderkey") / 100000), "rn")
    return numbered.select(F.floor((F.col("rn") - 1) / 25).alias("page"), "o_custkey", "o_orderkey")
