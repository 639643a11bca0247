"""Access control over customers (users), nations (groups), segments (roles) and suppliers (resources)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.fixed import EDIT, VIEW
from convolake.operators import acl as A
from convolake.operators import merge as M
from convolake.plans.joins import _ROLES, roles
from convolake.plans.registry import query
from convolake.sources.tables import ACL_SQL

PRINCIPAL_SQL = """pri AS (SELECT c_custkey AS user_id, 'user' AS principal_type, CAST(c_custkey AS VARCHAR) AS principal_id FROM customer
  UNION ALL SELECT c_custkey, 'role', c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE'
  UNION ALL SELECT c_custkey, 'group', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, 'public', NULL FROM customer)"""


def principals(t):
    c = t.customer
    outside = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ext-"), F.col("c_custkey").cast("string")))
    users = c.select(
        F.col("c_custkey").alias("user_id"),
        outside.alias("source_id"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment")).alias("role"),
    )
    members = c.select(
        F.col("c_nationkey").alias("group_id"), F.coalesce(outside, F.col("c_custkey").cast("string")).alias("member")
    )
    return A.principals(users, members)


@query("j9_principals", f"WITH {PRINCIPAL_SQL} SELECT user_id, principal_type, principal_id FROM pri")
def _(t):
    return principals(t)


@query(
    "j10_accessible",
    f"""WITH {PRINCIPAL_SQL}, {ACL_SQL} SELECT DISTINCT user_id, resource_id FROM pri JOIN acl ON acl.principal_type = pri.principal_type
          AND CAST(acl.principal_id AS VARCHAR) = pri.principal_id WHERE perm_bits & 3 = 3
        UNION ALL SELECT DISTINCT NULL, resource_id FROM acl WHERE principal_type = 'public' AND perm_bits & 3 = 3""",
)
def _(t):
    personal, public = A.accessible(principals(t), t.acl(), VIEW | EDIT)
    # resources open to everybody are listed once, without a user
    return personal.unionByName(public.select(F.lit(None).cast("bigint").alias("user_id"), "resource_id"))


@query(
    "a5_effective_permissions",
    f"""WITH {PRINCIPAL_SQL}, {ACL_SQL},
        own AS (SELECT DISTINCT user_id, resource_id FROM pri JOIN acl ON acl.principal_type = pri.principal_type
          AND acl.principal_type <> 'public' AND CAST(acl.principal_id AS VARCHAR) = pri.principal_id)
        SELECT own.user_id, own.resource_id, CAST(bit_or(perm_bits) AS INTEGER) AS bits FROM own JOIN acl ON acl.resource_id = own.resource_id
          AND (acl.principal_type = 'public' OR EXISTS (SELECT 1 FROM pri WHERE pri.user_id = own.user_id
            AND pri.principal_type = acl.principal_type AND pri.principal_id = CAST(acl.principal_id AS VARCHAR))) GROUP BY ALL
        UNION ALL SELECT NULL, resource_id, CAST(bit_or(perm_bits) AS INTEGER) FROM acl WHERE principal_type = 'public' GROUP BY resource_id""",
)
def _(t):
    return A.effective(principals(t), t.acl())


@query(
    "t28_role_labels",
    f"""WITH {ACL_SQL}, level(bits, label) AS (VALUES (0, 'none'), (1, 'viewer'), (2, 'editor'), (3, 'editor'), (4, 'owner'),
          (5, 'owner'), (6, 'owner'), (7, 'owner'), (8, 'none'), (9, 'viewer'), (10, 'editor'), (11, 'editor'), (12, 'owner'),
          (13, 'owner'), (14, 'owner'), (15, 'owner'))
        SELECT resource_id, perm_bits, label FROM acl JOIN level ON bits = perm_bits""",
)
def _(t):
    return t.acl().select("resource_id", "perm_bits", A.role_label(F.col("perm_bits")).alias("label"))


@query(
    "j12_file_access",
    """WITH link AS (SELECT DISTINCT l_suppkey AS agent_id, l_partkey AS file_id FROM lineitem WHERE l_returnflag <> 'A'),
       ways AS (SELECT p_partkey AS file_id, p_size AS user_id, 0 AS r FROM part
         UNION ALL SELECT file_id, s_nationkey, 1 FROM link JOIN supplier ON s_suppkey = agent_id
         UNION ALL SELECT file_id, 1000 + s_suppkey % 7, 2 FROM link JOIN supplier ON s_suppkey = agent_id WHERE (1 + s_suppkey % 8) & 2 = 2)
       SELECT file_id, user_id, ['owner', 'author', 'editor'][min(r) + 1] AS reason FROM ways GROUP BY file_id, user_id""",
)
def _(t):
    attached = t.lineitem.filter("l_returnflag <> 'A'").select(F.col("l_suppkey").alias("agent_id"), F.col("l_partkey").alias("file_id"))
    s = t.supplier
    agents = s.select(F.col("s_suppkey").alias("agent_id"), F.col("s_nationkey").cast("bigint").alias("author"))
    edits = s.filter((1 + F.col("s_suppkey") % 8).bitwiseAND(F.lit(EDIT)) == EDIT).select(
        F.col("s_suppkey").alias("agent_id"), (1000 + F.col("s_suppkey") % 7).alias("user_id")
    )
    files = t.part.select(F.col("p_partkey").alias("file_id"), F.col("p_size").cast("bigint").alias("owner"))
    return A.file_access(files, attached, agents, edits)


_CHANGES = """chg AS (SELECT 'agent' AS resource_type, o_orderkey % 120 AS resource_id, 'user' AS principal_type, o_custkey AS principal_id,
    CASE WHEN o_orderstatus = 'P' THEN 'revoke' ELSE 'grant' END AS action,
    CASE o_orderkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' WHEN 2 THEN 'owner' ELSE 'admin' END AS role FROM orders),
tgt AS (SELECT 'agent' AS resource_type, resource_id, principal_type, principal_id, perm_bits FROM acl WHERE principal_type <> 'public'),
new AS (SELECT resource_type, resource_id, principal_type, principal_id, max(role_bits) AS b FROM chg JOIN roles USING (resource_type, role)
        WHERE action = 'grant' GROUP BY ALL)"""


def grants(t):
    k = F.col("o_orderkey")
    changes = t.orders.select(
        F.lit("agent").alias("resource_type"),
        (k % 120).alias("resource_id"),
        F.lit("user").alias("principal_type"),
        F.col("o_custkey").alias("principal_id"),
        F.when(F.col("o_orderstatus") == "P", "revoke").otherwise("grant").alias("action"),
        F.element_at(F.array(*map(F.lit, ["viewer", "editor", "owner", "admin"])), (k % 4 + 1).cast("int")).alias("role"),
    )
    stored = t.acl().filter("principal_type <> 'public'").withColumn("resource_type", F.lit("agent"))
    return A.apply_grants(stored, changes, roles(t.spark))


@query(
    "m9_bulk_grants",
    f"""WITH {ACL_SQL}, {_ROLES}, {_CHANGES}, snap AS (SELECT resource_type, resource_id, principal_type, principal_id,
          coalesce(b, perm_bits) AS perm_bits FROM tgt FULL JOIN new USING (resource_type, resource_id, principal_type, principal_id))
        SELECT * FROM snap q WHERE NOT EXISTS (SELECT 1 FROM chg c WHERE c.action = 'revoke' AND c.resource_id = q.resource_id
          AND c.principal_type = q.principal_type AND c.principal_id = q.principal_id)""",
)
def _(t):
    return grants(t)[0]


@query(
    "m9_rejected_grants",
    f"""WITH {ACL_SQL}, {_ROLES}, {_CHANGES} SELECT resource_type, resource_id, principal_type, principal_id, 'role_not_found' AS problem
        FROM chg WHERE action = 'grant' AND role NOT IN (SELECT role FROM roles)""",
)
def _(t):
    return grants(t)[1]


@query(
    "m9_modify_bits",
    f"WITH {ACL_SQL} SELECT resource_id, perm_bits, (perm_bits | 6) & ~1 AS changed FROM acl",
)
def _(t):
    return t.acl().select("resource_id", "perm_bits", M.bits_changed(F.col("perm_bits"), add=6, remove=1).alias("changed"))
