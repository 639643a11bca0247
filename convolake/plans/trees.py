"""Conversation trees over the given conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import trees as T
from convolake.plans.registry import query
from convolake.sources.tables import MSG_SQL

# The last message of each conversation as target, and one in its middle for splits.
WALK_SQL = f"""{MSG_SQL},
target AS (SELECT conv_id, max(msg) AS target FROM msg GROUP BY conv_id),
middle AS (SELECT conv_id, CAST(max(msg) // 2 AS BIGINT) AS target FROM msg GROUP BY conv_id),
walk AS (SELECT conv_id, target, target AS msg, 0 AS up FROM target
         UNION ALL SELECT w.conv_id, w.target, m.parent, w.up + 1 FROM walk w JOIN msg m ON m.conv_id = w.conv_id
           AND m.msg = w.msg WHERE m.parent <> -1),
lev AS (SELECT conv_id, msg, 0 AS depth, msg AS root FROM msg WHERE parent = -1
        UNION ALL SELECT m.conv_id, m.msg, l.depth + 1, l.root FROM lev l JOIN msg m ON m.conv_id = l.conv_id AND m.parent = l.msg)"""
LEVEL_SQL = "SELECT m.*, lev.depth, lev.root FROM msg m JOIN lev USING (conv_id, msg)"


def targets(m):
    return m.groupBy("conv_id").agg(F.max("msg").alias("target"))


def middles(m):
    return m.groupBy("conv_id").agg(F.floor(F.max("msg") / 2).alias("target"))


@query("g5_depth", f"WITH RECURSIVE {WALK_SQL} SELECT conv_id, msg, depth, root FROM ({LEVEL_SQL})")
def _(t):
    return T.depths(t.messages().select("conv_id", "msg", "parent")).select("conv_id", "msg", "depth", "root")


@query(
    "g1_path_to_root",
    f"""WITH RECURSIVE {WALK_SQL} SELECT conv_id, target, msg, max(up) OVER (PARTITION BY conv_id) - up AS position, text
        FROM walk JOIN msg USING (conv_id, msg)""",
)
def _(t):
    m = t.messages()
    return T.path_to_root(m, targets(m)).select("conv_id", "target", "msg", "position", "text")


@query(
    "w9_path_from_summary",
    f"""WITH RECURSIVE {WALK_SQL}, r AS (SELECT w.*, m.role, m.text, m.summary FROM walk w JOIN msg m USING (conv_id, msg)),
        cut AS (SELECT conv_id, min(up) AS c FROM r WHERE summary IS NOT NULL GROUP BY conv_id)
        SELECT conv_id, msg, CASE WHEN summary IS NOT NULL THEN 'system' ELSE role END AS role, coalesce(summary, text) AS text,
          max(up) OVER (PARTITION BY conv_id) - up AS position FROM r LEFT JOIN cut USING (conv_id) WHERE c IS NULL OR up <= c""",
)
def _(t):
    m = t.messages()
    return T.path_to_root(m, targets(m), summary="summary").select("conv_id", "msg", "role", "text", "position")


@query(
    "g2_path_with_siblings",
    f"""WITH RECURSIVE {WALK_SQL} SELECT m.conv_id, m.msg, t.target FROM msg m JOIN target t USING (conv_id)
        WHERE EXISTS (SELECT 1 FROM walk w WHERE w.conv_id = m.conv_id AND (w.msg = m.msg
          OR (w.msg = m.parent AND m.parent <> t.target)))""",
)
def _(t):
    m = t.messages()
    return T.path_with_siblings(m, targets(m)).select("conv_id", "msg", "target")


@query(
    "g3_up_to_target_level",
    f"""WITH RECURSIVE {WALK_SQL}, l AS ({LEVEL_SQL}) SELECT l.conv_id, l.msg, t.target FROM l JOIN middle t USING (conv_id)
        JOIN l x ON x.conv_id = l.conv_id AND x.msg = t.target WHERE l.depth <= x.depth""",
)
def _(t):
    m = t.messages()
    return T.up_to_target_level(m, middles(m)).select("conv_id", "msg", "target")


@query(
    "g4_split_at_level",
    f"""WITH RECURSIVE {WALK_SQL}, l AS ({LEVEL_SQL}) SELECT l.conv_id, l.msg, CASE WHEN l.depth = x.depth THEN -1 ELSE l.parent END
        AS parent FROM l JOIN middle t USING (conv_id) JOIN l x ON x.conv_id = l.conv_id AND x.msg = t.target
        WHERE l.depth >= x.depth""",
)
def _(t):
    m = t.messages()
    return T.split_at_target_level(m, middles(m)).select("conv_id", "msg", "parent")


@query(
    "w3_sibling_index",
    f"""WITH RECURSIVE {WALK_SQL} SELECT conv_id, msg, row_number() OVER (PARTITION BY conv_id, parent ORDER BY created_at, msg) - 1
        AS sibling, depth FROM ({LEVEL_SQL})""",
)
def _(t):
    return T.sibling_index(T.depths(t.messages())).select("conv_id", "msg", "sibling", "depth")


_FIXED = """fix AS (SELECT conv_id, msg, parent, epoch_ms(created_at) - CASE WHEN msg % 3 = 2 THEN 3600000 ELSE 0 END AS t FROM msg),
chain AS (SELECT conv_id, msg, t AS fixed_ms FROM fix WHERE parent = -1
          UNION ALL SELECT f.conv_id, f.msg, greatest(f.t, c.fixed_ms + 1) FROM chain c JOIN fix f
            ON f.conv_id = c.conv_id AND f.parent = c.msg)"""


def untidy(t):
    m = t.messages()
    late = F.when(F.col("msg") % 3 == 2, F.col("created_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("created_at"))
    return m.withColumn("created_at", late)


@query(
    "w12_time_after_parent",
    f"WITH RECURSIVE {WALK_SQL}, {_FIXED} SELECT conv_id, msg, fixed_ms FROM chain",
)
def _(t):
    return T.later_than_parent(untidy(t)).select("conv_id", "msg", "fixed_ms")


def clone_sql(fork: str, rows: str) -> str:
    """Clone of ``rows`` (conv_id, msg, parent, t, text) with corrected times."""
    new = lambda c: f"sha256('{fork}|' || conv_id || '|' || {c})"
    return f"""src AS ({rows}), cl AS (SELECT s.conv_id, s.msg, s.t AS fixed_ms FROM src s
      WHERE NOT EXISTS (SELECT 1 FROM src p WHERE p.conv_id = s.conv_id AND p.msg = s.parent)
      UNION ALL SELECT s.conv_id, s.msg, greatest(s.t, cl.fixed_ms + 1) FROM cl JOIN src s ON s.conv_id = cl.conv_id AND s.parent = cl.msg)
    SELECT conv_id, msg AS source_msg, {new('msg')} AS new_id, CASE WHEN EXISTS (SELECT 1 FROM src p WHERE p.conv_id = src.conv_id
      AND p.msg = src.parent) THEN {new('parent')} END AS new_parent, text, fixed_ms FROM src JOIN cl USING (conv_id, msg)"""


_ROWS = "SELECT m.conv_id, m.msg, m.parent, f.t, m.text FROM msg m JOIN fix f USING (conv_id, msg)"


@query("g7_clone", f"WITH RECURSIVE {WALK_SQL}, {_FIXED}, {clone_sql('clone', _ROWS)}")
def _(t):
    return T.cloned(untidy(t), "clone")


@query(
    "g8_fork_direct_path",
    f"WITH RECURSIVE {WALK_SQL}, {_FIXED}, {clone_sql('f1', _ROWS + ' JOIN walk USING (conv_id, msg)')}",
)
def _(t):
    m = untidy(t)
    return T.fork(m, targets(m), "direct_path", "f1")


@query(
    "g8_fork_include_branches",
    f"""WITH RECURSIVE {WALK_SQL}, {_FIXED}, {clone_sql('f2', _ROWS + ''' JOIN target t USING (conv_id)
        WHERE EXISTS (SELECT 1 FROM walk w WHERE w.conv_id = m.conv_id AND (w.msg = m.msg
          OR (w.msg = m.parent AND m.parent <> t.target)))''')}""",
)
def _(t):
    m = untidy(t)
    return T.fork(m, targets(m), "include_branches", "f2")


@query(
    "g8_fork_target_level",
    f"""WITH RECURSIVE {WALK_SQL}, {_FIXED}, {clone_sql('f3', _ROWS + ''' JOIN lev USING (conv_id, msg) JOIN middle t USING (conv_id)
        JOIN lev x ON x.conv_id = m.conv_id AND x.msg = t.target WHERE lev.depth <= x.depth''')}""",
)
def _(t):
    m = untidy(t)
    return T.fork(m, middles(m), "target_level", "f3")


_SPLIT = f"""l AS ({LEVEL_SQL}), sp AS (SELECT l.conv_id, l.msg, CASE WHEN l.depth = x.depth THEN -1 ELSE l.parent END AS parent FROM l
  JOIN middle t USING (conv_id) JOIN l x ON x.conv_id = l.conv_id AND x.msg = t.target WHERE l.depth >= x.depth),
up2 AS (SELECT conv_id, target AS msg FROM target UNION ALL SELECT u.conv_id, s.parent FROM up2 u JOIN sp s ON s.conv_id = u.conv_id
  AND s.msg = u.msg WHERE s.parent <> -1)"""


@query(
    "g8_fork_split_latest",
    f"""WITH RECURSIVE {WALK_SQL}, {_FIXED}, {_SPLIT}, {clone_sql('f4', 'SELECT s.conv_id, s.msg, s.parent, f.t, m.text FROM sp s '
        'JOIN up2 USING (conv_id, msg) JOIN fix f USING (conv_id, msg) JOIN msg m USING (conv_id, msg)')}""",
)
def _(t):
    m = untidy(t)
    return T.fork(m, middles(m), "direct_path", "f4", split_latest=targets(m))


@query(
    "g9_duplicate",
    f"""WITH RECURSIVE {WALK_SQL}, {_FIXED}, {clone_sql('d', _ROWS + ''' JOIN lev USING (conv_id, msg) JOIN target t USING (conv_id)
        JOIN lev x ON x.conv_id = m.conv_id AND x.msg = t.target WHERE lev.depth <= x.depth''')}""",
)
def _(t):
    m = untidy(t)
    return T.fork(m, targets(m), "target_level", "d")


LINEAR_SQL = f"""{WALK_SQL},
sib AS (SELECT *, row_number() OVER (PARTITION BY conv_id, parent ORDER BY created_at, msg) - 1 AS s,
               row_number() OVER (PARTITION BY conv_id, parent ORDER BY created_at DESC, msg DESC) = 1 AS is_last FROM msg),
pre AS (SELECT conv_id, msg, [s] AS path, is_last AS on_last FROM sib WHERE parent = -1
        UNION ALL SELECT b.conv_id, b.msg, list_append(p.path, b.s), p.on_last AND b.is_last FROM pre p JOIN sib b
          ON b.conv_id = p.conv_id AND b.parent = p.msg),
lin AS (SELECT conv_id, msg, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position, on_last AS on_last_branch FROM pre)"""


@query("g10_linearise", f"WITH RECURSIVE {LINEAR_SQL} SELECT conv_id, msg, position, on_last_branch FROM lin")
def _(t):
    return T.linearised(t.messages()).select("conv_id", "msg", "position", "on_last_branch")


_BROKEN = """b AS (SELECT conv_id, msg, CASE WHEN conv_id % 7 = 0 AND msg = 1 THEN 3 WHEN conv_id % 11 = 0 AND msg = 2 THEN 99
  ELSE parent END AS parent FROM msg)"""


@query(
    "g11_audit",
    f"""WITH RECURSIVE {MSG_SQL}, {_BROKEN}, ok AS (SELECT conv_id, msg FROM b WHERE NOT EXISTS (SELECT 1 FROM b p
          WHERE p.conv_id = b.conv_id AND p.msg = b.parent)
          UNION ALL SELECT b.conv_id, b.msg FROM ok JOIN b ON b.conv_id = ok.conv_id AND b.parent = ok.msg)
        SELECT conv_id, msg, 'orphan' AS problem FROM b WHERE parent <> -1 AND NOT EXISTS (SELECT 1 FROM b p
          WHERE p.conv_id = b.conv_id AND p.msg = b.parent)
        UNION ALL SELECT conv_id, msg, 'cycle' FROM b WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.conv_id = b.conv_id AND ok.msg = b.msg)""",
)
def _(t):
    conv, msg = F.col("conv_id"), F.col("msg")
    broken = (
        F.when((conv % 7 == 0) & (msg == 1), 3).when((conv % 11 == 0) & (msg == 2), 99).otherwise(F.col("parent"))
    )
    return T.audit(t.messages().select("conv_id", "msg", broken.cast("bigint").alias("parent")))
