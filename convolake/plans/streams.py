"""Streams over the given tables and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.text import token_estimate
from convolake.operators import scan
from convolake.plans.registry import query
from convolake.session import fresh_path
from convolake.sources.tables import MSG_SQL
from convolake.streaming import limits as L
from convolake.streaming import stateful as St
from convolake.streaming.runner import run_update, table_stream

LIMIT = 3  # requests per window in these queries

_RATE = f"""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, user_id, count(*) AS n, count(*) - {LIMIT} AS excess
  FROM events GROUP BY time_bucket(INTERVAL 6 HOUR, ts), user_id HAVING count(*) > {LIMIT}"""


def _start(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("st1_rate_limit_batch", _RATE)
def _(t):
    return _start(L.over_limit(L.window_counts(t.events.select("ts", "user_id"), "user_id", "6 hours"), LIMIT))


@query("st1_rate_limit_stream", _RATE)
def _(t):
    events = table_stream(t.spark, t.folder, "events").select("ts", "user_id")
    return _start(L.stream_over_limit(events, "user_id", "6 hours", LIMIT))


def hourly():
    return F.date_trunc("hour", "ts")


def violations(events):
    """Errors weigh five points, failed sign-ups one; each user has a score of its own for each kind."""
    return events.filter(F.col("event_type").isin("error", "signup")).select(
        F.concat_ws(":", "user_id", "event_type").alias("key"), "ts", F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", 5.0).otherwise(1.0).alias("delta"),
    )


_SCORES = """v AS (SELECT user_id AS key, event_type AS type, ts, event_id AS id, CASE event_type WHEN 'error' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS d FROM events
    WHERE event_type IN ('error', 'signup')),
c AS (SELECT *, sum(d) OVER (PARTITION BY key, type ORDER BY ts, id) AS score FROM v),
ban AS (SELECT key, type, id, ts AS starts, ts + INTERVAL 120 MINUTE AS expires, score FROM c WHERE floor((score - d) / 20) < floor(score / 20))"""
_BANS = f"WITH {_SCORES} SELECT key, type, id, starts, expires, score FROM ban"


def by_user(found):
    """Bans with the user as key and the kind of violation that led to them."""
    parts = F.split("key", ":")
    return found.withColumns({"key": parts[0].cast("bigint"), "type": parts[1]})


def bans(t):
    return by_user(L.crossings(L.clamped_ledger(violations(t.events), hourly())))


@query("w7_threshold_crossing", _BANS)
def _(t):
    return bans(t)


@query("st3_violation_bans_stream", _BANS)
def _(t):
    return by_user(L.crossings(L.stream_ledger(violations(table_stream(t.spark, t.folder, "events")), hourly(), "violations")))


@query(
    "st4_banned_requests",
    f"""WITH {_SCORES} SELECT event_id AS id, user_id AS key, max(expires) AS banned_until FROM events JOIN ban ON ban.key = user_id
        AND events.ts >= starts AND events.ts < expires GROUP BY 1, 2""",
)
def _(t):
    requests = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")
    return L.banned(requests, bans(t)).select("id", "key", "banned_until")


@query(
    "st4_banned_until",
    f"""WITH {_SCORES} SELECT key, max(expires) AS expires, max(expires) > TIMESTAMP '2024-01-20' AS active FROM ban GROUP BY key""",
)
def _(t):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return bans(t).groupBy("key").agg(F.max("expires").alias("expires")).withColumn("active", F.col("expires") > now)


_BALANCES = """WITH RECURSIVE e AS (SELECT user_id AS user, event_id AS id, ts, value AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
g(user, id, rn, balance, last, refilled) AS (
  SELECT DISTINCT user, NULL::BIGINT, 0::BIGINT, 500.0::DOUBLE, NULL::TIMESTAMP, FALSE FROM e
  UNION ALL
  SELECT user, id, rn, greatest(0.0, balance + CASE WHEN refill THEN 300.0 ELSE 0.0 END - cost), CASE WHEN refill THEN ts ELSE last END, refill
  FROM (SELECT e.*, g.balance, g.last, g.balance - e.cost <= 0 AND (g.last IS NULL OR g.last + INTERVAL 2 DAY <= e.ts) AS refill
        FROM g JOIN e ON e.user = g.user AND e.rn = g.rn + 1))
SELECT user, id, balance, refilled FROM g WHERE rn > 0"""


@query("st5_balance_with_refill", _BALANCES)
def _(t):
    costs = table_stream(t.spark, t.folder, "events").select(
        F.col("user_id").alias("user"), "ts", F.col("event_id").alias("id"), F.col("value").alias("cost")
    )
    return St.stream_balances(costs, opening=500.0, amount=300.0, every_days=2)


@query("st7_growing_text")
def _(t):
    looks = fresh_path(t.spark, "looks")
    n = F.length("text")
    # every message is seen five times while it grows; the last look is complete
    seen = t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), "text", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seq")
    ).select(
        "key", "seq", F.substr("text", F.lit(1), F.ceil(n * F.col("seq") / 5).cast("int")).alias("text"), (F.col("seq") == 5).alias("complete")
    )
    seen.write.parquet(looks)
    stream = t.spark.readStream.schema(seen.schema).parquet(looks)
    return St.stream_growing_texts(stream)


@query("st8_live_counts", "SELECT user_id, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY user_id")
def _(t):
    stream = table_stream(t.spark, t.folder, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    return run_update(stream, ["user_id"], "live-counts")


@query("st8_live_conversations", "SELECT conv_id % 50 AS user_id, count(DISTINCT conv_id) AS conversations, count(*) AS messages FROM conversations GROUP BY 1")
def _(t):
    """A conversation counts once its first message arrives."""
    stream = table_stream(t.spark, t.folder, "conversations").groupBy((F.col("conv_id") % 50).alias("user_id"))
    totals = stream.agg(F.count_if(F.col("turn") == 0).alias("conversations"), F.count("*").alias("messages"))
    return run_update(totals, ["user_id"], "live-conversations")


@query(
    "st9_memory_admission",
    f"""WITH {MSG_SQL}, tot AS (SELECT conv_id, CAST(coalesce(sum(tokens) FILTER (role = 'user'), 0) AS BIGINT) AS total FROM msg GROUP BY 1)
        SELECT conv_id, msg, CASE WHEN role NOT IN ('user', 'assistant') THEN 'invalid_key' WHEN total >= 250 THEN 'already_exceeded'
          WHEN total + tokens > 250 THEN 'would_exceed' ELSE 'stored' END AS status,
          CASE WHEN role NOT IN ('user', 'assistant') THEN NULL WHEN total >= 250 THEN total - 250 WHEN total + tokens > 250 THEN total + tokens - 250 END AS over
        FROM msg JOIN tot USING (conv_id)""",
)
def _(t):
    m = t.messages()
    # stored memories are the user's messages; every message asks to be stored under its role as key
    totals = m.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", F.col("tokens")).otherwise(0)).alias("total"))
    asked = m.select("conv_id", "msg", "role", token_estimate(F.col("text")).alias("tokens"))
    asked = scan.with_key_row(asked, totals, ["conv_id"], F.floor(F.col("msg") / 512))
    limit, total, after = 250, F.col("total"), F.col("total") + F.col("tokens")
    valid = F.col("role").isin("user", "assistant")
    return asked.select(
        "conv_id",
        "msg",
        F.when(~valid, "invalid_key").when(total >= limit, "already_exceeded").when(after > limit, "would_exceed").otherwise("stored").alias("status"),
        F.when(~valid, None).when(total >= limit, total - limit).when(after > limit, after - limit).alias("over"),
    )
