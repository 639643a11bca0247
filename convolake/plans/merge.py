"""Merges, deletes and counters over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import fragments as Fr
from convolake.operators import merge as M
from convolake.operators import scan
from convolake.operators import sets as S
from convolake.plans.registry import query
from convolake.sources.tables import MSG_SQL


@query(
    "m1_upsert",
    """WITH src AS (SELECT o_orderkey + 2000 AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice
         FROM orders WHERE o_orderstatus = 'P')
       SELECT o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice, o_orderdate
       FROM orders t FULL JOIN src s USING (o_orderkey)""",
)
def _(t):
    target = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    source = t.orders.filter("o_orderstatus = 'P'").select(
        (F.col("o_orderkey") + 2000).alias("o_orderkey"),
        "o_custkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
    return M.upsert(target, source, ["o_orderkey"])


_SEED = """seed(n_nationkey, n_name) AS (SELECT c_nationkey + 15, min(c_mktsegment) FROM customer GROUP BY 1)"""


@query(
    "m2_insert_absent",
    f"""WITH {_SEED} SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM seed WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)""",
)
def _(t):
    seed = t.customer.groupBy((F.col("c_nationkey") + 15).alias("n_nationkey")).agg(F.min("c_mktsegment").alias("n_name"))
    return M.insert_absent(t.nation.select("n_nationkey", "n_name"), seed, ["n_nationkey"])


@query(
    "m3_save_conversation",
    f"""WITH {MSG_SQL} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY msg) - 1 AS position, msg::VARCHAR AS fragment,
          CASE WHEN conv_id % 2 = 0 THEN 'renamed' ELSE 'kept' END AS title, CASE WHEN conv_id % 3 <> 0 THEN 'm' || conv_id END AS model
        FROM msg""",
)
def _(t):
    conv = F.col("conv_id")
    stored = t.conversations.select("conv_id").distinct().select(
        "conv_id", F.lit("kept").alias("title"), F.concat(F.lit("m"), conv.cast("string")).alias("model")
    )
    changes = stored.filter(conv % 2 == 0).select("conv_id", F.lit("renamed").alias("title"))
    saved = M.upsert(stored, changes, ["conv_id"]).withColumn("model", F.when(conv % 3 != 0, F.col("model")))
    # the message list of a conversation is a row per message
    parts = Fr.fragments(t.conversations, ["conv_id"], ["turn"], F.floor(F.col("turn") / 512), F.col("turn").cast("string"))
    return scan.with_key_row(parts, saved, ["conv_id"], Fr.block())


@query(
    "m4_cascade_delete",
    """WITH doomed AS (SELECT o_orderkey FROM orders WHERE o_totalprice < 50000)
       SELECT 'orders' AS table_name, count(*) AS kept FROM orders WHERE o_orderkey NOT IN (FROM doomed)
       UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM doomed)
       UNION ALL SELECT 'deleted', count(*) FROM doomed""",
)
def _(t):
    doomed = t.orders.filter("o_totalprice < 50000").select("o_orderkey")
    orders = M.delete_matching(t.orders.select("o_orderkey"), doomed, ["o_orderkey"])
    lines = M.delete_matching(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), doomed, ["o_orderkey"])
    n = lambda df, name: df.agg(F.count("*").alias("kept")).select(F.lit(name).alias("table_name"), "kept")
    return n(orders, "orders").unionByName(n(lines, "lineitem")).unionByName(n(doomed, "deleted"))


@query(
    "m5_purge_user",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < -500)
       SELECT 'customer' AS table_name, count(*) AS deleted FROM gone
       UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (FROM gone)
       UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IN (FROM gone)""",
)
def _(t):
    gone = t.customer.filter("c_acctbal < -500").select("c_custkey")
    tables = {
        "customer": (t.customer.select("c_custkey"), "c_custkey"),
        "orders": (t.orders.select("o_orderkey", "o_custkey"), "o_custkey"),
        "events": (t.events.select("event_id", "user_id"), "user_id"),
    }
    return M.purge_user(tables, gone, "c_custkey")[1]


@query(
    "m6_delete_since",
    f"""WITH {MSG_SQL}, mark AS (SELECT conv_id, created_at AS c FROM msg WHERE msg = 2)
        SELECT conv_id, msg FROM msg LEFT JOIN mark USING (conv_id) WHERE c IS NULL OR created_at <= c""",
)
def _(t):
    m = t.messages()
    return M.delete_since(m, m.filter("msg = 2").select("conv_id", "msg")).select("conv_id", "msg")


@query(
    "m7_add_counts",
    """WITH tgt AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1),
       d AS (SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END) AS x FROM events
             WHERE event_type IN ('purchase', 'error') GROUP BY 1)
       SELECT user_id, CAST(coalesce(n, 0) + coalesce(x, 0) AS BIGINT) AS n FROM tgt FULL JOIN d USING (user_id)""",
)
def _(t):
    e = t.events
    stored = e.filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"))
    deltas = e.filter(F.col("event_type").isin("purchase", "error")).select(
        "user_id", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("delta")
    )
    return M.add_counts(stored, deltas, ["user_id"], "n").select("user_id", F.col("n").cast("bigint").alias("n"))


@query(
    "m8_bulk_update",
    """SELECT p_partkey, coalesce(s.size, p_size) AS p_size, 'reset' AS state FROM part LEFT JOIN (
         SELECT l_partkey, CAST(max(l_quantity) AS INTEGER) AS size FROM lineitem WHERE l_discount = 0.1 GROUP BY 1) s ON l_partkey = p_partkey""",
)
def _(t):
    new = (
        t.lineitem.filter("l_discount = 0.1")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.max("l_quantity").cast("int").alias("p_size"))
    )
    return M.update_by_key(t.part.select("p_partkey", "p_size"), new, ["p_partkey"]).withColumn("state", F.lit("reset"))


@query(
    "m10_merge_permissions",
    """SELECT s_suppkey, s_suppkey % 2 = 0 AS prompts_use, s_suppkey % 3 = 0 AS prompts_share, s_nationkey % 2 = 0 AS agents_use,
         (s_suppkey % 2 = 0) <> FALSE OR NOT (s_nationkey % 2 = 0) AS changed FROM supplier""",
)
def _(t):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    flags = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    stored = F.create_map(
        F.lit("PROMPTS"), flags("USE", F.lit(False), "SHARE", k % 3 == 0), F.lit("AGENTS"), flags("USE", F.lit(True))
    )
    given = F.create_map(F.lit("PROMPTS"), flags("USE", k % 2 == 0), F.lit("AGENTS"), flags("USE", n % 2 == 0))
    rows = t.supplier.select("s_suppkey", stored.alias("stored"), given.alias("given"))
    merged = rows.withColumn("merged", M.merged_permissions(F.col("stored"), F.col("given")))
    return merged.select(
        "s_suppkey",
        F.col("merged")["PROMPTS"]["USE"].alias("prompts_use"),
        F.col("merged")["PROMPTS"]["SHARE"].alias("prompts_share"),
        F.col("merged")["AGENTS"]["USE"].alias("agents_use"),
        (~M.same_map(F.col("stored"), F.col("merged"))).alias("changed"),
    )


def part_versions(t):
    history = t.lineitem.select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return M.version_rows(
        history, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"], F.floor(F.col("l_orderkey") / 5000),
        ["l_returnflag", "l_linestatus"],
    )


@query(
    "m11_versions",
    """WITH h AS (SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, lag(l_returnflag || l_linestatus) OVER w AS b FROM lineitem
         WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey))
       SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS version
       FROM h WHERE b IS DISTINCT FROM l_returnflag || l_linestatus""",
)
def _(t):
    return part_versions(t)


@query(
    "m11_revert",
    """WITH h AS (SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, lag(l_returnflag || l_linestatus) OVER w AS b FROM lineitem
         WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey)),
       v AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS version FROM h
         WHERE b IS DISTINCT FROM l_returnflag || l_linestatus),
       q AS (SELECT p_partkey AS l_partkey, 1 + p_partkey % 5 AS wanted FROM part),
       n AS (SELECT l_partkey, max(version) AS n, arg_max(l_returnflag || l_linestatus, version) AS last FROM v GROUP BY 1)
       SELECT l_partkey, wanted, l_returnflag, l_linestatus, CASE WHEN version IS NULL THEN 'missing' WHEN l_returnflag || l_linestatus = last THEN 'unchanged'
         ELSE 'appended' END AS status, CASE WHEN l_returnflag || l_linestatus <> last THEN n + 1 ELSE n END AS version
       FROM q LEFT JOIN v USING (l_partkey) LEFT JOIN n USING (l_partkey) WHERE version = wanted
       UNION ALL SELECT l_partkey, wanted, NULL, NULL, 'missing', n FROM q LEFT JOIN n USING (l_partkey) WHERE wanted > coalesce(n, 0)""",
)
def _(t):
    """Every part goes back to one of the first five versions of its status, where it has that many."""
    wanted = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 5 + 1).alias("wanted"))
    return M.reverted(part_versions(t), wanted, ["l_partkey"], ["l_returnflag", "l_linestatus"])


@query(
    "m12_pointer_repair",
    """WITH par AS (SELECT o_custkey, max(o_orderkey) AS pointer FROM orders GROUP BY 1),
       ch AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_totalprice > 150000),
       lat AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM ch GROUP BY 1)
       SELECT o_custkey, CASE WHEN EXISTS (SELECT 1 FROM ch WHERE ch.o_orderkey = par.pointer) THEN pointer ELSE latest END AS pointer
       FROM par JOIN lat USING (o_custkey)""",
)
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    parents = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("pointer"))
    remaining = o.filter("o_totalprice > 150000")
    return M.repaired_pointer(parents, remaining, "o_custkey", "o_orderkey", "o_orderdate")


@query(
    "m13_ttl_purge",
    """SELECT event_type, count(*) AS kept FROM events WHERE CASE event_type WHEN 'view' THEN ts + INTERVAL 1 HOUR
         WHEN 'signup' THEN ts + INTERVAL 7 DAY WHEN 'click' THEN ts + INTERVAL 30 DAY END IS NULL OR
         CASE event_type WHEN 'view' THEN ts + INTERVAL 1 HOUR WHEN 'signup' THEN ts + INTERVAL 7 DAY WHEN 'click' THEN ts + INTERVAL 30 DAY END
         > TIMESTAMP '2024-01-20' GROUP BY 1""",
)
def _(t):
    from convolake.operators.predicates import visible_at

    # Lifetimes of files, unverified users and temporary messages.
    ts, kind = F.col("ts"), F.col("event_type")
    expires = (
        F.when(kind == "view", ts + F.expr("INTERVAL 1 HOUR"))
        .when(kind == "signup", ts + F.expr("INTERVAL 7 DAY"))
        .when(kind == "click", ts + F.expr("INTERVAL 30 DAY"))
    )
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    kept = t.events.select("event_type", expires.alias("expires")).filter(visible_at("expires", now))
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))


@query(
    "m14_single_default",
    """SELECT o_orderkey, o_custkey, o_orderpriority = '1-URGENT' AND o_orderkey = (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders x
         WHERE x.o_custkey = o.o_custkey AND x.o_orderpriority = '1-URGENT') AS is_default FROM orders o""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").alias("is_default"))
    return M.single_default(o, "o_custkey", "o_orderkey", "is_default", "o_orderdate").select(
        "o_orderkey", "o_custkey", F.coalesce("is_default", F.lit(False)).alias("is_default")
    )


@query(
    "m15_balance_config",
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_nationkey % 3 = 0 OR a IS NULL THEN 'credits' END,
         CASE WHEN c_mktsegment <> 'BUILDING' OR a IS NULL THEN 'interval' END], lambda x: x IS NOT NULL), ',') AS changed
       FROM customer LEFT JOIN (SELECT c_custkey, 1 AS a FROM customer WHERE c_acctbal > 0) USING (c_custkey)
       WHERE c_nationkey % 3 = 0 OR c_mktsegment <> 'BUILDING' OR a IS NULL""",
)
def _(t):
    c = t.customer
    wanted = c.select("c_custkey", F.lit(20000).alias("credits"), F.lit("days").alias("interval"))
    stored = c.filter("c_acctbal > 0").select(
        "c_custkey",
        F.when(F.col("c_nationkey") % 3 == 0, 5).otherwise(20000).alias("credits"),
        F.when(F.col("c_mktsegment") == "BUILDING", "days").otherwise("weeks").alias("interval"),
    )
    return M.changed_fields(wanted, stored, "c_custkey", ["credits", "interval"]).select(
        "c_custkey", F.array_join("changed", ",").alias("changed")
    )


@query(
    "m16_project_members",
    """SELECT p_partkey, array_to_string(list_sort(list_filter([1, p_size % 5, 9], lambda x: x <> 3)), ',') AS projects,
         list_contains([1, p_size % 5], 3) AS left_project FROM part""",
)
def _(t):
    size = (F.col("p_size") % 5).cast("int")
    ids = F.array(F.lit(1), size)
    joined = S.pull(F.concat(ids, F.array(F.lit(9))), F.lit(3))
    return t.part.select(
        "p_partkey",
        F.array_join(F.transform(F.array_sort(joined), lambda x: x.cast("string")), ",").alias("projects"),
        F.array_contains(ids, 3).alias("left_project"),
    )


@query(
    "m17_share_requests",
    """WITH c AS (SELECT conv_id, conv_id % 10 AS owner, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY 1)
       SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 3 ELSE conv_id % 10 END AS "user", n AS n_messages,
         CASE WHEN conv_id % 6 = 5 AND conv_id % 4 <> 0 THEN 'exists' WHEN CASE WHEN conv_id % 4 = 0 THEN 3 ELSE conv_id % 10 END <> owner THEN 'not_owner'
           WHEN n = 0 THEN 'empty' END AS reject_reason FROM c""",
)
def _(t):
    conv = F.col("conv_id")
    convs = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_messages"))
    convs = convs.withColumn("owner", conv % 10)
    requests = convs.select("conv_id", F.when(conv % 4 == 0, F.lit(3)).otherwise(conv % 10).alias("user"))
    shares = convs.filter(conv % 6 == 5).select("conv_id", (conv % 10).alias("user")).filter(conv % 4 != 0)
    return M.share_requests(requests, convs, shares)


@query(
    "w11_position_shift",
    """SELECT p_partkey, p, CASE WHEN p = 10 THEN 200 WHEN p > 10 AND p <= 200 THEN p - 1 ELSE p END AS moved_down,
         CASE WHEN p = 200 THEN 10 WHEN p >= 10 AND p < 200 THEN p + 1 ELSE p END AS moved_up,
         CASE WHEN p > 50 THEN p - 1 ELSE p END AS after_delete
       FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS p FROM part)""",
)
def _(t):
    rows = scan.with_number(t.part.select("p_partkey", "p_type"), ["p_type"], ["p_partkey"], F.floor(F.col("p_partkey") / 100000), "p")
    p = F.col("p")
    return rows.select(
        "p_partkey",
        "p",
        M.moved(p, F.lit(10), F.lit(200)).alias("moved_down"),
        M.moved(p, F.lit(200), F.lit(10)).alias("moved_up"),
        M.after_delete(p, F.lit(50)).alias("after_delete"),
    )
