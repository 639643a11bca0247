"""Requests replayed at 2 000 times their speed: rate limits, pending requests, violations and bans; growing texts; index runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.plans.registry import query
from convolake.plans.text import trim_sql
from convolake.session import fresh_path
from convolake.streaming import keyed as K
from convolake.streaming.index import BucketedIndex
from convolake.streaming.runner import run_batches, run_update, table_stream

FROM = 1_704_067_200_000_000  # 2024-01-01 in microseconds
SPEED = 2000
US = f"{FROM} + (epoch_us(ts) - {FROM}) // {SPEED}"


def replayed(events):
    us = F.lit(FROM) + F.floor((K.micros("ts") - FROM) / SPEED)
    return events.withColumn("us", us.cast("bigint"))


def moves(events):
    """Every event but an error starts a request, an error finishes one."""
    return replayed(events).select(F.col("user_id").alias("key"), "us", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("starts"))


_PENDING = f"""WITH RECURSIVE m AS (SELECT user_id AS key, event_id AS id, us, event_type <> 'error' AS starts,
    row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM (SELECT *, {US} AS us FROM events)),
g(key, id, rn, changed, pending, denied) AS (
  SELECT key, id, rn, CASE WHEN starts THEN us ELSE 0 END, CASE WHEN starts THEN 1 ELSE 0 END, FALSE FROM m WHERE rn = 1
  UNION ALL
  SELECT key, id, rn, CASE WHEN (starts AND p < 2) OR (NOT starts AND p > 0) THEN us ELSE changed END,
    CASE WHEN starts AND p < 2 THEN p + 1 WHEN NOT starts AND p > 0 THEN p - 1 ELSE p END, starts AND p >= 2
  FROM (SELECT m.*, g.changed, CASE WHEN m.us - g.changed > 60000000 THEN 0 ELSE g.pending END AS p FROM g JOIN m ON m.key = g.key AND m.rn = g.rn + 1))
SELECT key, id, pending, denied FROM g"""


@query("st2_pending_gauge_batch", _PENDING)
def _(t):
    return K.batch_pending(moves(t.events))


@query("st2_pending_gauge_stream", _PENDING)
def _(t):
    return K.stream_pending(moves(table_stream(t.spark, t.folder, "events")))


def requests(events):
    """Messages, log-ins and registrations of a few accounts at a few addresses."""
    kind = F.when(F.col("event_type") == "error", "login").when(F.col("event_type") == "signup", "register").otherwise("message")
    address = F.concat(F.lit("10.0.0."), (F.col("user_id") % 8).cast("string"))
    return replayed(events).select(kind.alias("kind"), "us", F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("user"), address.alias("ip"))


_LIMITED = f"""rules(limiter, most, width, type) AS (VALUES ('message', 40, 60000000, 'message_limit'), ('login', 7, 300000000, 'logins'), ('register', 5, 3600000000, 'registrations')),
r AS (SELECT CASE event_type WHEN 'error' THEN 'login' WHEN 'signup' THEN 'register' ELSE 'message' END AS limiter, {US} AS us, event_id AS id, user_id % 5 AS user,
        '10.0.0.' || (user_id % 8) AS ip FROM events),
k AS (SELECT r.*, k.key_kind, CASE k.key_kind WHEN 'user' THEN r.user::VARCHAR ELSE r.ip END AS key, most, type, us - us % width AS start
      FROM r JOIN rules USING (limiter), (VALUES ('user'), ('ip')) k(key_kind)),
n AS (SELECT *, row_number() OVER (PARTITION BY limiter, key_kind, key, start ORDER BY us, id) AS n FROM k),
denied AS (SELECT *, 1.0::DOUBLE AS score FROM n WHERE n > most)"""
_WINDOWS = f"WITH {_LIMITED} SELECT limiter, key_kind, key, start, max(n) AS n, max(n) - any_value(most) AS excess FROM n GROUP BY ALL HAVING max(n) > any_value(most)"
_DENIED = f"WITH {_LIMITED} SELECT limiter, key_kind, key, id, us, user, ip, type, score, n FROM denied"
_BANS = f"""WITH {_LIMITED},
s AS (SELECT *, sum(score) OVER (PARTITION BY user, type ORDER BY us, id, limiter, key_kind) AS total FROM denied),
c AS (SELECT * FROM s WHERE floor((total - score) / 20) < floor(total / 20))
SELECT k.key_kind, CASE k.key_kind WHEN 'user' THEN user::VARCHAR ELSE ip END AS key, user, type, id, us AS starts, us + 7200000000 AS expires, total AS score
FROM c, (VALUES ('user'), ('ip')) k(key_kind)"""


def excess(totals):
    return totals.filter(F.col("n") > F.col("most")).select(*K.KEYS, "start", "n", (F.col("n") - F.col("most")).alias("excess"))


@query("st1_limiters_batch", _WINDOWS)
def _(t):
    return excess(K.window_totals(K.limited(requests(t.events))))


@query("st1_limiters_stream", _WINDOWS)
def _(t):
    totals = K.window_totals(K.limited(requests(table_stream(t.spark, t.folder, "events"))))
    return excess(run_update(totals, [*K.KEYS, "start"], "limits"))


@query("st1_denied_batch", _DENIED)
def _(t):
    return K.batch_denied(K.limited(requests(t.events)))


def denied_stream(t):
    return K.stream_denied(K.limited(requests(table_stream(t.spark, t.folder, "events"))))


@query("st1_denied_stream", _DENIED)
def _(t):
    return denied_stream(t)


@query("st3_limit_bans_batch", _BANS)
def _(t):
    return K.batch_bans(K.batch_denied(K.limited(requests(t.events))))


@query("st3_limit_bans_stream", _BANS)
def _(t):
    # the files of the first stream are the source of the second
    denied = denied_stream(t)
    path = denied.inputFiles()[0].rsplit("/", 2)[0] + "/batch=*"
    return K.stream_bans(t.spark.readStream.schema(denied.schema).parquet(path))


LOOKS = 16


def looks(conversations):
    """Sixteen looks at every message: it grows and is complete at the fifth, is missing at first or always, or stops short."""
    kind, seq = (F.col("conv_id") * 31 + F.col("turn")) % 4, F.col("seq")
    shown = F.when((kind == 2) | ((kind == 1) & (seq <= 3)), None).otherwise(
        F.substr("text", F.lit(1), F.ceil(F.length("text") * F.least(seq, F.when(kind == 3, 4).otherwise(5)) / 5).cast("int"))
    )
    return conversations.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(LOOKS)))).select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), (F.lit(FROM) + seq * 1_000_000).alias("us"), "seq", shown.alias("text"), ((kind < 2) & (seq >= 5)).alias("complete")
    )


_MARKS = ".?!۔。‥;¡¿\\n"  # single characters that may end a chunk; the texts hold no fences
_LOOKS = f"""WITH RECURSIVE l AS (SELECT conv_id || '-' || turn AS key, seq, CASE WHEN kind = 2 OR (kind = 1 AND seq <= 3) THEN NULL
      ELSE left(text, CAST(ceil(length(text) * least(seq, CASE kind WHEN 3 THEN 4 ELSE 5 END) / 5) AS BIGINT)) END AS text, kind < 2 AND seq >= 5 AS complete
    FROM (SELECT *, (conv_id * 31 + turn) % 4 AS kind FROM conversations), range(1, {LOOKS + 1}) s(seq)),
g(key, seq, sent, missing, unchanged, chunk, outcome) AS (
  SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, 0, 0, NULL::VARCHAR, NULL::VARCHAR FROM l
  UNION ALL
  SELECT key, seq, CASE WHEN gone THEN sent WHEN complete THEN length(text) WHEN length(rest) >= 20 THEN sent + length(cut) ELSE sent END,
    CASE WHEN gone THEN missing + 1 ELSE missing END, CASE WHEN rest = '' THEN unchanged + 1 ELSE unchanged END,
    CASE WHEN gone THEN NULL WHEN complete THEN nullif({trim_sql('rest')}, '') WHEN length(rest) >= 20 THEN cut END,
    CASE WHEN gone THEN CASE WHEN missing >= 5 THEN 'missing' END WHEN complete THEN 'finished' WHEN length(rest) >= 20 THEN 'chunk'
      WHEN rest = '' AND unchanged >= 9 THEN 'unchanged' END
  FROM (SELECT *, CASE WHEN mark = '' THEN rest ELSE mark END AS cut FROM (
    SELECT g.key, l.seq, sent, missing, unchanged, l.text, l.complete, l.text IS NULL AS gone, substr(l.text, sent + 1) AS rest,
      regexp_extract(substr(l.text, sent + 1), '(?s)^.*[{_MARKS}]') AS mark
    FROM g JOIN l ON l.key = g.key AND l.seq = g.seq + 1 WHERE coalesce(outcome, 'chunk') = 'chunk')))
SELECT key, seq, chunk, outcome FROM g WHERE outcome IS NOT NULL"""


@query("st7_given_up_texts", _LOOKS)
def _(t):
    path = fresh_path(t.spark, "looks")
    seen = looks(t.conversations)
    seen.write.parquet(path)
    return K.stream_looks(t.spark.readStream.schema(seen.schema).parquet(path))


@query(
    "st6_incremental_index",
    """SELECT doc_id, source, lang || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN '*' ELSE '' END AS lang,
              CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 1 ELSE 0 END AS run
       FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 13 <> 0""",
)
def _(t):
    """Three runs: two thirds of the documents; the others, changes and repeats; removals. Documents also vanish unsaid."""
    third, fifth, eleventh = (F.col("doc_id") % n == 0 for n in (3, 5, 11))
    changed = F.when(fifth & ~third, F.concat("lang", F.lit("*"))).otherwise(F.col("lang"))
    rows = t.documents.select("doc_id", "source", "lang")
    no = F.lit(False)
    runs = [
        rows.filter(~third).withColumn("gone", no),
        rows.filter(third | fifth | eleventh).withColumn("lang", changed).withColumn("gone", no),
        rows.filter("doc_id % 7 = 0").withColumn("gone", F.lit(True)),
    ]
    source = t.documents.select("doc_id").filter("doc_id % 7 <> 0 AND doc_id % 13 <> 0")
    feed, checkpoint = fresh_path(t.spark, "feed"), fresh_path(t.spark, "index-checkpoint")
    index = BucketedIndex(t.spark, fresh_path(t.spark, "index"), "doc_id", list(rows.schema), buckets=16)
    shape = runs[0].withColumn("at", F.lit(0)).schema
    for number, run in enumerate(runs):
        run.withColumn("at", F.lit(number)).write.mode("append").parquet(feed)
        stream = t.spark.readStream.schema(shape).parquet(feed)
        run_batches(stream, "append", lambda batch, at: index.apply(batch, source, at, "at") and None, "index", checkpoint)
    index.sweep(source, len(runs))
    return index.read(len(runs)).select("doc_id", "source", "lang", "run")
