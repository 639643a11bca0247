"""Billing over the given tables: line items and parts as usage, events as a ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions import rates
from convolake.operators import billing as B
from convolake.plans.registry import query
from convolake.sources.tables import USAGE_SQL

# Model names of the parts: every brand and type stands for one of these.
MODELS = [
    "gpt-4o-mini-2024-07-18", "claude-3-5-sonnet-20241022", "o1-preview-2024", "gpt-3.5-turbo", "unlisted-model",
    "gemini-1.5-flash-8b-001", "gpt-4-turbo-preview", "claude-instant-1", "deepseek-chat", "mistral-large-2407",
    "claude-3-haiku", "gpt-5-nano-x", "grok-3-mini-beta", "llama-3.1-70b-instruct", "us.amazon.nova-lite-v1:0", "us.deepseek.r1-v1:0",
    "ai21.jamba-instruct-v1:0", "openai/gpt-oss-20b", "kimi-k2", "qwen2.5:14b", "claude-opus-4-20250514", "grok-4-0709", "o4-mini-2025", "command-r-plus",
]
TYPE_PATTERNS = ["e", "small", "o", "stan", "dium", "promo", "standard", "large", "arge", "eco", "zz"]


def values_sql(name: str, columns: str, rows) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)})"


DIMS_SQL = ", ".join(
    [
        values_sql("names", "i, model", list(enumerate(MODELS))),
        values_sql("prices", "pattern, prompt, completion, ord", [(k, float(p), float(c), i) for i, (k, (p, c)) in enumerate(rates.PRICES.items())]),
        values_sql("cache", "pattern, write, read", [(k, float(w), float(r)) for k, (w, r) in rates.CACHE_PRICES.items()]),
        values_sql("rules", "pattern, key, ord", [(p, k, i) for i, (p, k) in enumerate(rates.KEY_RULES)]),
        values_sql("limits", "pattern, tokens, ord", [(p, v, i) for i, (p, v) in enumerate(rates.CONTEXT_LIMITS.items())]),
        """lim AS (SELECT model, (SELECT arg_max(pattern, CASE WHEN pattern = model THEN 10000 ELSE ord END) FROM limits
             WHERE contains(model, pattern)) AS hit FROM names)""",
        """keys AS (SELECT model, coalesce((SELECT arg_min(key, ord) FROM rules WHERE contains(coalesce(hit, model), pattern)),
             (SELECT pattern FROM prices WHERE pattern = coalesce(hit, model))) AS key FROM lim)""",
        """rate AS (SELECT model, key, coalesce(p.prompt, 6) AS prompt, coalesce(p.completion, 6) AS completion, write, read
             FROM keys LEFT JOIN prices p ON p.pattern = key LEFT JOIN cache c ON c.pattern = key)""",
        f"""use AS (SELECT l_suppkey AS "user", l_orderkey AS conversation_id, l_linenumber AS line, l_partkey, model,
             l_quantity AS prompt_tokens, CAST(l_linenumber AS DOUBLE) AS completion_tokens,
             CASE WHEN l_returnflag = 'R' THEN 'incomplete' ELSE 'message' END AS context
             FROM lineitem JOIN part ON p_partkey = l_partkey JOIN names ON i = p_partkey % {len(MODELS)})""",
    ]
)


# What every model must be billed and limited by (key, prompt, completion, cache write, cache read, context, output).
EXPECTED = [
    ("ai21.jamba-instruct-v1:0", "ai21.jamba-instruct-v1:0", 0.5, 0.7, None, None, 255500, 1024),
    ("claude-3-5-sonnet-20241022", "claude-3-5-sonnet", 3.0, 15.0, 3.75, 0.3, 200000, 8192),
    ("claude-3-haiku", "claude-3-haiku", 0.25, 1.25, 0.3, 0.03, 200000, 4096),
    ("claude-instant-1", "claude-instant", 0.8, 2.4, None, None, 100000, 1024),
    ("claude-opus-4-20250514", "claude-opus-4", 15.0, 75.0, 18.75, 1.5, 200000, 32000),
    ("command-r-plus", "command-r-plus", 3.0, 15.0, None, None, 127500, 1024),
    ("deepseek-chat", "deepseek", 0.14, 0.28, None, None, 63000, 1024),
    ("gemini-1.5-flash-8b-001", "gemini-1.5-flash-8b", 0.075, 0.3, None, None, 1000000, 1024),
    ("gpt-3.5-turbo", "4k", 1.5, 2.0, None, None, 16375, 1024),
    ("gpt-4-turbo-preview", "gpt-4-1106", 10.0, 30.0, None, None, 127500, 1024),
    ("gpt-4o-mini-2024-07-18", "gpt-4o-mini", 0.15, 0.6, None, None, 127500, 1024),
    ("gpt-5-nano-x", "gpt-5-nano", 0.05, 0.4, None, None, 400000, 128000),
    ("grok-3-mini-beta", "grok-3-mini", 0.3, 0.5, None, None, 131072, 1024),
    ("grok-4-0709", "grok-4", 3.0, 15.0, None, None, 256000, 1024),
    ("kimi-k2", None, 6.0, 6.0, None, None, 131000, 1024),
    ("llama-3.1-70b-instruct", "llama-3.1-70b", 0.72, 0.72, None, None, 127500, 1024),
    ("mistral-large-2407", "mistral-large-2407", 3.0, 9.0, None, None, 127500, 1024),
    ("o1-preview-2024", "o1-preview", 15.0, 60.0, None, None, 127500, 32268),
    ("o4-mini-2025", "o4-mini", 1.1, 4.4, None, None, 200000, 1024),
    ("openai/gpt-oss-20b", "gpt-oss-20b", 0.05, 0.2, None, None, 131000, 131000),
    ("qwen2.5:14b", None, 6.0, 6.0, None, None, 32000, 1024),
    ("unlisted-model", None, 6.0, 6.0, None, None, None, 1024),
    ("us.amazon.nova-lite-v1:0", "amazon.nova-lite-v1:0", 0.06, 0.24, None, None, 295000, 1024),
    ("us.deepseek.r1-v1:0", "deepseek.r1", 1.35, 5.4, None, None, 127500, 1024),
]
EXPECTED_SQL = values_sql("expected", "model, key, prompt, completion, write, read, context, output", EXPECTED)
SEEN_SQL = f"seen AS (SELECT DISTINCT model FROM part JOIN names ON i = p_partkey % {len(MODELS)})"


def model_of(part_key):
    return F.element_at(F.array(*map(F.lit, MODELS)), (part_key % len(MODELS) + 1).cast("int"))


def usage(t):
    """Usage rows with real model names; the model follows from the part."""
    return t.lineitem.select(
        F.col("l_suppkey").alias("user"),
        F.col("l_orderkey").alias("conversation_id"),
        F.col("l_linenumber").alias("line"),
        "l_partkey",
        model_of(F.col("l_partkey")).alias("model"),
        F.col("l_quantity").alias("prompt_tokens"),
        F.col("l_linenumber").cast("double").alias("completion_tokens"),
        F.when(F.col("l_returnflag") == "R", "incomplete").otherwise("message").alias("context"),
    )


def models(t):
    return t.part.select(model_of(F.col("p_partkey")).alias("model"))


@query(
    "j15_pattern_match",
    f"""WITH {values_sql('pat', 'ord, pattern', list(enumerate(TYPE_PATTERNS)))}, {USAGE_SQL}
        SELECT model, pattern, count(*) AS n FROM usage JOIN (SELECT m, (SELECT arg_max(pattern, CASE WHEN pattern = m THEN 10000
          ELSE ord END) FROM pat WHERE contains(m, pattern)) AS pattern FROM (SELECT DISTINCT model AS m FROM usage)) ON m = model
        GROUP BY ALL""",
)
def _(t):
    patterns = t.spark.createDataFrame([(p, i) for i, p in enumerate(TYPE_PATTERNS)], "pattern string, ord int")
    parts = t.part.select(F.lower("p_type").alias("model"))
    counts = t.usage().groupBy("model").agg(F.count("*").alias("n"))
    return counts.join(B.match_patterns(parts, patterns), "model", "left").select("model", "pattern", "n")


@query("j16_billing_key", f"WITH {DIMS_SQL}, {EXPECTED_SQL}, {SEEN_SQL} SELECT model, key FROM expected JOIN seen USING (model)")
def _(t):
    return B.model_rates(models(t)).select("model", "key")


@query(
    "b1_rate_resolution",
    f"""WITH {DIMS_SQL} SELECT conversation_id, line, l_partkey, "user", CASE
          WHEN line % 5 = 0 THEN CASE WHEN use.model = 'gpt-3.5-turbo' THEN 0.25 ELSE 6 END
          WHEN line % 5 = 1 THEN 60 WHEN line % 5 = 2 THEN 1 ELSE coalesce(rate.completion, 6) END AS rate
        FROM use LEFT JOIN rate USING (model)""",
)
def _(t):
    u = usage(t).join(B.model_rates(models(t)), "model", "left")
    line = F.col("line") % 5
    none = F.lit(None).cast("double")
    rate = B.resolve_rate(
        line == 0,
        F.when(F.col("model") == "gpt-3.5-turbo", F.lit(0.25)),
        F.when(line == 1, F.lit(float(rates.PRICES["8k"][1]))).otherwise(none),
        F.lit("completion"),
        F.when(line != 2, F.col("model")),
        F.col("completion"),
    )
    return u.select("conversation_id", "line", "l_partkey", "user", rate.alias("rate"))


@query(
    "b2_cache_rates",
    f"WITH {DIMS_SQL}, {EXPECTED_SQL}, {SEEN_SQL} SELECT model, prompt, completion, write, read FROM expected JOIN seen USING (model)",
)
def _(t):
    return B.model_rates(models(t)).drop("key")


_TX = """tx AS (SELECT "user", conversation_id, line, l_partkey, context, model, 'prompt' AS token_type, -greatest(prompt_tokens, 0) AS raw_amount,
    prompt AS base FROM use JOIN rate USING (model)
  UNION ALL SELECT "user", conversation_id, line, l_partkey, context, model, 'completion', -greatest(completion_tokens, 0), completion
    FROM use JOIN rate USING (model)),
ledger AS (SELECT *, CASE WHEN token_type = 'completion' AND context = 'incomplete' THEN ceil(raw_amount * base * 1.15::DOUBLE)
    ELSE raw_amount * base END AS token_value, CASE WHEN token_type = 'completion' AND context = 'incomplete' THEN base * 1.15::DOUBLE
    ELSE base END AS rate FROM tx)"""


@query(
    "b3_token_value",
    f"""WITH {DIMS_SQL}, {_TX} SELECT model, context, count(*) AS n, round(sum(token_value), 4) AS token_value, round(max(rate), 6) AS rate
        FROM ledger WHERE token_type = 'completion' GROUP BY ALL""",
)
def _(t):
    tx = B.usage_transactions(usage(t), B.model_rates(models(t)))
    return (
        tx.filter("token_type = 'completion'")
        .groupBy("model", "context")
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum("token_value"), 4).alias("token_value"),
            F.round(F.max("rate"), 6).alias("rate"),
        )
    )


@query(
    "b4_structured_value",
    f"""WITH {DIMS_SQL} SELECT conversation_id, line, l_partkey, "user",
          round(-(prompt_tokens * prompt + line * 10 * coalesce(write, prompt) + completion_tokens * coalesce(read, prompt)), 6) AS token_value,
          -(prompt_tokens + line * 10 + completion_tokens) AS raw_amount,
          round((prompt_tokens * prompt + line * 10 * coalesce(write, prompt) + completion_tokens * coalesce(read, prompt))
            / (prompt_tokens + line * 10 + completion_tokens), 6) AS rate
        FROM use JOIN rate USING (model)""",
)
def _(t):
    u = usage(t).join(B.model_rates(models(t)), "model")
    value, raw, rate = B.structured_prompt(
        F.col("prompt_tokens"), (F.col("line") * 10).cast("double"), F.col("completion_tokens"),
        F.col("prompt"), F.col("write"), F.col("read"),
    )
    return u.select(
        "conversation_id", "line", "l_partkey", "user",
        F.round(value, 6).alias("token_value"), raw.alias("raw_amount"), F.round(rate, 6).alias("rate"),
    )


@query(
    "b5_transactions",
    f"""WITH {DIMS_SQL}, {_TX} SELECT "user", conversation_id, line, l_partkey, model, context, token_type, raw_amount,
          round(rate, 6) AS rate, round(token_value, 6) AS token_value FROM ledger""",
)
def _(t):
    tx = B.usage_transactions(usage(t), B.model_rates(models(t)))
    return tx.withColumns({"rate": F.round("rate", 6), "token_value": F.round("token_value", 6)})


def ledger(t):
    return t.events.select(
        F.col("user_id").alias("user"),
        "ts",
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value")).alias("delta"),
    )


_LEDGER = """l AS (SELECT user_id AS "user", ts, event_id AS id, CASE WHEN event_type = 'purchase' THEN value ELSE -value END AS delta FROM events),
s AS (SELECT *, 100 + sum(delta) OVER (PARTITION BY "user" ORDER BY ts, id) AS s FROM l)"""


@query(
    "w6_running_balance",
    f"""WITH {_LEDGER} SELECT "user", id, round(s - least(0, min(s) OVER (PARTITION BY "user" ORDER BY ts, id)), 4) + 0 AS balance FROM s""",
)
def _(t):
    rows = B.running_balance(ledger(t), 100.0, F.date_trunc("hour", "ts"))
    return rows.select("user", "id", (F.round("balance", 4) + 0).alias("balance"))


@query(
    "b6_final_balance",
    """SELECT user_id AS "user", round(list_reduce(list_prepend(100.0::DOUBLE, list(CASE WHEN event_type = 'purchase' THEN value ELSE -value END
         ORDER BY ts, event_id)), lambda a, d: greatest(0, a + d)), 4) + 0 AS balance FROM events GROUP BY user_id""",
)
def _(t):
    rows = B.final_balance(ledger(t), 100.0, F.date_trunc("hour", "ts"))
    return rows.select("user", (F.round("balance", 4) + 0).alias("balance"))


@query(
    "b7_spend_check",
    """SELECT o_orderkey, c_custkey, o_totalprice * 0.05::DOUBLE AS cost, c_acctbal >= o_totalprice * 0.05::DOUBLE AS can_spend
       FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def _(t):
    cost = F.col("o_totalprice") * 0.05
    balances = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return t.orders.join(balances, "o_custkey").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), cost.alias("cost"), (F.col("c_acctbal") >= cost).alias("can_spend")
    )


@query(
    "b8_refill_due",
    """WITH last AS (SELECT o_custkey, max(o_orderdate) AS last_refill FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
       SELECT c_custkey, (c_acctbal - 4000 <= 0) AND c_mktsegment <> 'BUILDING' AND c_nationkey * 100 > 0
         AND (last_refill IS NULL OR last_refill + INTERVAL 30 DAY <= TIMESTAMP '1998-08-01') AS due
       FROM customer LEFT JOIN last ON o_custkey = c_custkey""",
)
def _(t):
    last = (
        t.orders.filter("o_orderstatus = 'P'")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max("o_orderdate").alias("last_refill"))
    )
    rows = t.customer.join(last, "c_custkey", "left")
    due = B.refill_due(
        F.col("c_acctbal"), F.lit(4000.0), F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey") * 100,
        F.col("last_refill"), B.add_interval(F.col("last_refill"), F.lit(30), F.lit("days")),
        F.lit("1998-08-01").cast("timestamp_ntz"),
    )
    return rows.select("c_custkey", due.alias("due"))


@query(
    "b9_add_interval",
    """SELECT o_orderkey, unit, CASE unit WHEN 'seconds' THEN d + to_seconds(n) WHEN 'minutes' THEN d + to_minutes(n)
         WHEN 'hours' THEN d + to_hours(n) WHEN 'days' THEN d + to_days(n) WHEN 'weeks' THEN d + to_days(7 * n)
         WHEN 'months' THEN date_trunc('month', d) + to_months(n) + to_days(CAST(day(d) AS INTEGER) - 1) + (d - date_trunc('day', d))
         ELSE d END AS next_at
       FROM (SELECT o_orderkey, o_orderdate + INTERVAL 90 MINUTE AS d, CAST(o_orderkey % 9 + 1 AS INTEGER) AS n,
         ['seconds', 'minutes', 'hours', 'days', 'weeks', 'months', 'fortnights'][CAST(o_orderkey % 7 + 1 AS INTEGER)] AS unit FROM orders)""",
)
def _(t):
    units = ["seconds", "minutes", "hours", "days", "weeks", "months", "fortnights"]
    unit = F.element_at(F.array(*map(F.lit, units)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    ts = F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTE")
    return t.orders.select(
        "o_orderkey", unit.alias("unit"), B.add_interval(ts, F.col("o_orderkey") % 9 + 1, unit).alias("next_at")
    )


@query(
    "b10_token_limits",
    f"WITH {DIMS_SQL}, {EXPECTED_SQL}, {SEEN_SQL} SELECT model, context, output FROM expected JOIN seen USING (model)",
)
def _(t):
    limit = lambda table: B.looked_up(B.contained(F.col("model"), list(table)), table)
    return (
        models(t)
        .distinct()
        .select(
            "model",
            limit(rates.CONTEXT_LIMITS).alias("context"),
            F.coalesce(limit(rates.OUTPUT_LIMITS), F.lit(rates.OUTPUT_DEFAULT)).alias("output"),
        )
    )


@query(
    "s19_price_list",
    """SELECT 'brand/' || p_partkey AS id, CAST(CAST(p_retailprice / 1e8 AS DECIMAL(18, 10)) AS VARCHAR) IS NOT NULL AS ok,
         round(CASE WHEN p_partkey = 0 THEN 10 ELSE round(p_retailprice / 1e8, 10) * 1e6 END, 6) AS prompt,
         round(CASE WHEN p_partkey = 0 THEN 30 ELSE round(p_retailprice / 5e7, 10) * 1e6 END, 6) AS completion, p_size * 1000 AS context
       FROM part""",
)
def _(t):
    from convolake.sources.files import price_list

    text = lambda by: F.format_number(F.col("p_retailprice") / by, 10)
    body = F.to_json(
        F.struct(
            F.concat(F.lit("brand/"), F.col("p_partkey").cast("string")).alias("id"),
            F.struct(text(1e8).alias("prompt"), text(5e7).alias("completion")).alias("pricing"),
            (F.col("p_size") * 1000).alias("context_length"),
        )
    )
    listed = price_list(t.part.select(body.alias("json")), "json", special={"brand/0": (0.00001, 0.00003)})
    return listed.select(
        "id", F.lit(True).alias("ok"), F.round("prompt", 6).alias("prompt"), F.round("completion", 6).alias("completion"), "context"
    )
