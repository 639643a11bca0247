"""Join queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import joins as J
from convolake.operators import scan
from convolake.plans.registry import query
from convolake.sources.tables import MSG_SQL


@query(
    "j1_left_lookup",
    "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0",
)
def _(t):
    c = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.select("o_orderkey", "o_custkey").join(c, "o_custkey", "left")


@query(
    "j2_polymorphic_lookups",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE l_returnflag WHEN 'A' THEN 'user' WHEN 'N' THEN 'group' ELSE 'role' END AS principal_type,
         CASE l_returnflag WHEN 'A' THEN c_name WHEN 'N' THEN n_name ELSE p_type END AS principal_name
       FROM lineitem
       LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = l_partkey AND l_returnflag = 'A'
       LEFT JOIN nation ON n_nationkey = l_suppkey AND l_returnflag = 'N'
       LEFT JOIN part ON p_partkey = l_partkey AND l_returnflag = 'R'
       WHERE l_returnflag = 'R' OR (l_returnflag = 'A' AND c_name IS NOT NULL)
          OR (l_returnflag = 'N' AND n_name IS NOT NULL)""",
)
def _(t):
    kind = (
        F.when(F.col("l_returnflag") == "A", "user").when(F.col("l_returnflag") == "N", "group").otherwise("role")
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("principal_type"))
    # the key is null for rows of another type, so each look-up only meets its own rows
    key = lambda name, col: F.when(F.col("principal_type") == name, F.col(col))
    users = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("uk"), F.col("c_name").alias("un"))
    groups = t.nation.select(F.col("n_nationkey").cast("bigint").alias("gk"), F.col("n_name").alias("gn"))
    roles = t.part.select(F.col("p_partkey").alias("rk"), F.col("p_type").alias("rn"))
    return (
        rows.join(users, key("user", "l_partkey") == F.col("uk"), "left")
        .join(groups, key("group", "l_suppkey") == F.col("gk"), "left")
        .join(roles, key("role", "l_partkey") == F.col("rk"), "left")
        .withColumn("principal_name", F.coalesce("un", "gn", "rn"))
        .filter((F.col("principal_type") == "role") | F.col("principal_name").isNotNull())
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "principal_type", "principal_name")
    )


@query(
    "j3_unmigrated_classes",
    """SELECT class, count(*) AS n FROM (
         SELECT CASE WHEN c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_acctbal > 5000
                       THEN 'global_edit'
                     WHEN c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'global_view'
                     ELSE 'private' END AS class
         FROM customer c WHERE NOT EXISTS (
           SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) GROUP BY class""",
)
def _(t):
    granted = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    shared = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    pending = t.customer.select("c_custkey", "c_nationkey", "c_acctbal").join(granted, "c_custkey", "left_anti")
    return (
        J.flagged(pending, shared, "c_nationkey", "is_global")
        .select(
            F.when(F.col("is_global") & (F.col("c_acctbal") > 5000), "global_edit")
            .when(F.col("is_global"), "global_view")
            .otherwise("private")
            .alias("class")
        )
        .groupBy("class")
        .agg(F.count("*").alias("n"))
    )


@query(
    "j4_listing_of_hits",
    """SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND source IN
       (SELECT source FROM documents WHERE n_chars > 8000)""",
)
def _(t):
    d = t.documents
    hits = d.filter("n_chars > 8000").select("source")
    return d.filter("lang = 'en'").join(hits, "source", "left_semi").select("doc_id", "lang", "n_chars")


@query(
    "j5_orphans",
    """SELECT l.doc_id FROM labels l WHERE NOT EXISTS (
         SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')""",
)
def _(t):
    return t.labels.select("doc_id").join(t.documents.filter("lang = 'en'").select("doc_id"), "doc_id", "left_anti")


@query(
    "j6_hit_enrichment",
    f"""WITH {MSG_SQL}, hit AS (SELECT conv_id, msg, CASE WHEN msg % 2 = 0 THEN replace(text, 'an', '<b>an</b>') END AS text
                                FROM msg WHERE contains(lower(text), 'an')),
         live AS (SELECT conv_id, count(*) AS n_messages FROM msg GROUP BY conv_id HAVING count(*) > 3)
        SELECT conv_id, h.msg, coalesce(h.text, m.text) AS text, m.role, n_messages
        FROM hit h LEFT JOIN msg m USING (conv_id, msg) JOIN live USING (conv_id)""",
)
def _(t):
    m = t.messages().select("conv_id", "msg", "role", "text", F.concat_ws(":", "conv_id", "msg").alias("key"))
    hits = m.filter(F.lower("text").contains("an")).select(
        "conv_id", "msg", "key", F.when(F.col("msg") % 2 == 0, F.replace("text", F.lit("an"), F.lit("<b>an</b>"))).alias("text")
    )
    live = m.groupBy("conv_id").agg(F.count("*").alias("n_messages")).filter("n_messages > 3")
    found = J.enriched(hits, m, "key", ["text", "role"])
    return scan.with_key_row(found, live, ["conv_id"], F.floor(F.col("msg") / 512)).drop("key")


@query(
    "j7_citation_metadata",
    """SELECT l.doc_id AS file_id, coalesce(d.lang || '-' || d.source, 'Unknown File') AS file_name,
              coalesce(nullif(d.source, 'src3'), 'local') AS storage
       FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'fr') d USING (doc_id)""",
)
def _(t):
    files = t.documents.filter("lang <> 'fr'").select(
        "doc_id", F.concat_ws("-", "lang", "source").alias("file_name"), F.nullif("source", F.lit("src3")).alias("storage")
    )
    return (
        t.labels.select("doc_id")
        .join(files, "doc_id", "left")
        .select(
            F.col("doc_id").alias("file_id"),
            J.with_default("file_name", "Unknown File").alias("file_name"),
            J.with_default("storage", "local").alias("storage"),
        )
    )


@query(
    "j8_categories_with_counts",
    """SELECT n_nationkey, n_name, count(c_custkey) AS n_customers FROM nation
       LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY ALL""",
)
def _(t):
    facts = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return J.counted(t.nation.select("n_nationkey", "n_name"), facts, "n_nationkey", "n_customers")


@query(
    "j11_public_flag",
    """SELECT p_partkey, p_name, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount >= 0.1)
       AS is_public FROM part""",
)
def _(t):
    marks = t.lineitem.filter("l_discount >= 0.1").select(F.col("l_partkey").alias("p_partkey"))
    return J.flagged(t.part.select("p_partkey", "p_name"), marks, "p_partkey", "is_public")


_LINK = """link AS (SELECT conv_id, list(turn ORDER BY turn DESC) AS refs FROM conversations
                    WHERE role <> 'system' GROUP BY conv_id)"""


@query(
    "j13_reference_list",
    f"""WITH {_LINK} SELECT conv_id, pos - 1 AS pos, turn, role, text FROM (
          SELECT conv_id, unnest(refs) AS turn, generate_subscripts(refs, 1) AS pos FROM link)
        JOIN conversations USING (conv_id, turn)""",
)
def _(t):
    c = t.conversations
    shown = c.filter("role <> 'system'").select("conv_id", "turn")
    refs = scan.packed_lists(shown, ["conv_id"], ["turn"], F.floor(F.col("turn") / 512), F.col("turn"), 512)
    # newest first across blocks: position counts down from the number of shown turns
    total = shown.groupBy("conv_id").agg(F.count("*").alias("n"))
    return (
        scan.with_key_row(refs.select("conv_id", "block", F.posexplode("items").alias("i", "turn")), total, ["conv_id"], F.col("block"))
        .select("conv_id", (F.col("n") - 1 - F.col("block") * 512 - F.col("i")).alias("pos"), "turn")
        .join(c, ["conv_id", "turn"])
        .select("conv_id", "pos", "turn", "role", "text")
    )


@query(
    "j14_users_with_balance",
    """SELECT c_custkey, c_name, round(b, 2) AS balance, b IS NOT NULL AS has_balance FROM customer
       LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
       ON o_custkey = c_custkey""",
)
def _(t):
    balances = (
        t.orders.filter("o_orderstatus = 'O'")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("balance"))
    )
    return (
        t.customer.select("c_custkey", "c_name")
        .join(balances, "c_custkey", "left")
        .withColumn("has_balance", F.col("balance").isNotNull())
    )


_GROUPS = """wanted AS (SELECT c_custkey AS member, c_nationkey AS grp FROM customer WHERE c_acctbal > 0),
current AS (SELECT DISTINCT o_custkey AS member, CAST(c_nationkey + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS INTEGER)
            AS grp FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000)"""


@query(
    "j19_membership_sync",
    f"""WITH {_GROUPS} SELECT member, grp, CASE WHEN in_c IS NULL THEN 'added' WHEN in_w IS NULL THEN 'removed'
          ELSE 'kept' END AS action
        FROM (SELECT *, TRUE AS in_w FROM wanted) FULL JOIN (SELECT *, TRUE AS in_c FROM current) USING (member, grp)""",
)
def _(t):
    wanted = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("grp"))
    current = (
        t.orders.filter("o_totalprice > 400000")
        .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        .select(
            F.col("o_custkey").alias("member"),
            (F.col("c_nationkey") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("grp"),
        )
    )
    return J.membership_diff(wanted, current, ["member", "grp"])


_ROLES = """roles(resource_type, role, role_bits) AS (VALUES ('agent', 'viewer', 1), ('agent', 'editor', 3),
  ('agent', 'owner', 15), ('group', 'viewer', 1), ('group', 'editor', 3), ('group', 'owner', 15))"""


def roles(spark):
    # Access roles and their bits.
    rows = [(rt, r, b) for rt in ("agent", "group") for r, b in (("viewer", 1), ("editor", 3), ("owner", 15))]
    return spark.createDataFrame(rows, "resource_type string, role string, role_bits int")


@query(
    "j20_role_for_bits",
    f"""WITH {_ROLES}, req AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'agent' ELSE 'group' END AS resource_type,
          CAST(o_orderkey % 16 AS INTEGER) AS bits FROM orders)
        SELECT o_orderkey, resource_type, bits, (SELECT arg_max(role, role_bits) FROM roles r
          WHERE r.resource_type = req.resource_type AND r.role_bits & bits = r.role_bits) AS role FROM req""",
)
def _(t):
    req = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, "agent").otherwise("group").alias("resource_type"),
        (F.col("o_orderkey") % 16).cast("int").alias("bits"),
    )
    return J.best_role(req, roles(t.spark), "bits").select("o_orderkey", "resource_type", "bits", "role")


@query(
    "j21_conversations_by_id",
    f"""WITH {MSG_SQL}, c AS (SELECT conv_id, max(created_at) AS updated_at, arg_min(text, msg) AS title
                              FROM msg GROUP BY conv_id)
        SELECT conv_id, updated_at, title FROM c WHERE conv_id IN (
          SELECT conv_id FROM msg WHERE role = 'system') AND updated_at < TIMESTAMP '2024-01-04'
        ORDER BY updated_at DESC, conv_id LIMIT 26""",
)
def _(t):
    m = t.messages()
    wanted = m.filter("role = 'system'").select("conv_id")
    convs = m.groupBy("conv_id").agg(F.max("created_at").alias("updated_at"), F.min_by("text", "msg").alias("title"))
    return (
        convs.join(wanted, "conv_id", "left_semi")
        .filter(F.col("updated_at") < F.lit("2024-01-04").cast("timestamp_ntz"))
        .orderBy(F.desc("updated_at"), "conv_id")
        .limit(26)
    )


@query(
    "j22_steps_with_messages",
    """SELECT o_orderkey, o_orderdate, l_linenumber AS message, l_quantity FROM orders
       LEFT JOIN (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R')
       ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 7 + 1 ORDER BY o_orderdate, o_orderkey""",
)
def _(t):
    steps = t.orders.select(
        "o_orderkey",
        "o_orderdate",
        F.struct(F.struct((F.col("o_orderkey") % 7 + 1).alias("message_id")).alias("message_creation")).alias("details"),
    )
    messages = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")
    return (
        steps.join(
            messages,
            (F.col("l_orderkey") == F.col("o_orderkey"))
            & (F.col("l_linenumber") == F.col("details.message_creation.message_id")),
            "left",
        )
        .select("o_orderkey", "o_orderdate", F.col("l_linenumber").alias("message"), "l_quantity")
        .orderBy("o_orderdate", "o_orderkey")
    )
