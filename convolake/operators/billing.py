"""Model prices, usage ledgers and balances.

Prices are resolved on the distinct models of the facts and joined back by equality. Patterns from a table meet the
models by an equi-join on short substrings (``retrieve.containing``), fixed lists by expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions import fixed, rates
from convolake.functions.text import let
from convolake.operators import scan
from convolake.operators.retrieve import containing
from convolake.session import broadcast_if_small


def match_patterns(models: DataFrame, patterns: DataFrame) -> DataFrame:
    """(model, pattern) per distinct model: the equal pattern, else the last contained one in list order."""
    names = models.select("model").filter("model IS NOT NULL").distinct()
    pairs = containing(names, "model", patterns, "pattern").join(patterns.select("pattern", "ord"), "pattern")
    return pairs.groupBy("model").agg(
        F.max_by("pattern", F.struct(F.col("pattern") == F.col("model"), "ord")).alias("pattern")
    )


def contained(text: Column, patterns: list[str]) -> Column:
    """The equal pattern, else the last one of a fixed list that the text contains, else null."""
    hits = F.filter(F.array(*map(F.lit, patterns)), lambda p: text.contains(p))
    return F.when(text.isin(patterns), text).otherwise(F.get(F.reverse(hits), F.lit(0)))


def looked_up(key: Column, table: dict[str, float]) -> Column:
    """Value of a fixed table, null for an unknown key."""
    cells = [c for k, v in table.items() for c in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*cells), F.coalesce(key, F.lit("")))


def billing_key(model: Column) -> Column:
    """The first rule contained in the resolved model name, else the name itself if it has a price, else null."""
    rules = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(k).alias("key")) for p, k in rates.KEY_RULES])
    name = F.coalesce(contained(model, list(rates.CONTEXT_LIMITS)), model)
    return let(
        name,
        lambda n: F.coalesce(
            F.get(F.filter(rules, lambda r: n.contains(r["part"])), F.lit(0))["key"], F.when(n.isin(list(rates.PRICES)), n)
        ),
    )


def model_rates(models: DataFrame) -> DataFrame:
    """(model, key, prompt, completion, write, read) with defaults for unknown models; cache rates may be null.

    The tables are fixed lists, so a distinct model is priced by expressions alone. The result has one row per model and
    is handed to every task while it is small, so facts stay where they are.
    """
    side = lambda table, i: {k: float(v[i]) for k, v in table.items()}
    key, default = F.col("key"), F.lit(fixed.DEFAULT_RATE)
    priced = (
        models.select("model")
        .filter("model IS NOT NULL")
        .distinct()
        .withColumn("key", billing_key(F.col("model")))
        .select(
            "model",
            "key",
            F.coalesce(looked_up(key, side(rates.PRICES, 0)), default).alias("prompt"),
            F.coalesce(looked_up(key, side(rates.PRICES, 1)), default).alias("completion"),
            looked_up(key, side(rates.CACHE_PRICES, 0)).alias("write"),
            looked_up(key, side(rates.CACHE_PRICES, 1)).alias("read"),
        )
    )
    return broadcast_if_small(priced)


def resolve_rate(config_present: Column, config_rate: Column, key_rate: Column, token_type: Column, model: Column, model_rate: Column) -> Column:
    """Order of precedence: endpoint configuration, given key, 1 without type or model, model, default."""
    default = F.lit(fixed.DEFAULT_RATE)
    return (
        F.when(config_present, F.coalesce(config_rate, default))
        .when(key_rate.isNotNull() & token_type.isNotNull(), key_rate)
        .when(token_type.isNull() | model.isNull(), F.lit(1.0))
        .otherwise(F.coalesce(model_rate, default))
    )


def token_value(raw: Column, rate: Column, token_type: Column, context: Column) -> tuple[Column, Column]:
    """(value, rate): raw amount times rate; cancelled completions cost 15 % more, rounded up."""
    cancelled = (token_type == "completion") & (context == "incomplete")
    value = raw * F.abs(rate)
    return (
        F.when(cancelled, F.ceil(value * fixed.CANCEL_RATE).cast("double")).otherwise(value),
        F.when(cancelled, F.abs(rate) * fixed.CANCEL_RATE).otherwise(F.abs(rate)),
    )


def structured_prompt(input_: Column, write: Column, read: Column, rate: Column, write_rate: Column, read_rate: Column):
    """(token value, raw amount, blended rate) of a prompt with cached parts."""
    amount = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    w_rate, r_rate = F.coalesce(write_rate, rate), F.coalesce(read_rate, rate)
    cost = amount(input_) * rate + amount(write) * w_rate + amount(read) * r_rate
    total = amount(input_) + amount(write) + amount(read)
    return -cost, -total, F.when(total > 0, F.abs(cost) / total).otherwise(F.abs(rate))


def usage_transactions(usage: DataFrame, rates_: DataFrame) -> DataFrame:
    """Usage rows → one transaction per given side, negative amounts counted as none."""
    side = lambda kind, amount: F.struct(
        F.lit(kind).alias("token_type"), (-F.greatest(F.col(amount), F.lit(0.0))).alias("raw_amount")
    )
    rows = (
        usage.withColumn("_t", F.array(side("prompt", "prompt_tokens"), side("completion", "completion_tokens")))
        .withColumn("_t", F.explode(F.filter("_t", lambda s: s["raw_amount"].isNotNull())))
        .join(rates_, "model", "left")
    )
    kind = F.col("_t.token_type")
    rate = F.coalesce(F.when(kind == "prompt", F.col("prompt")).otherwise(F.col("completion")), F.lit(fixed.DEFAULT_RATE))
    value, final = token_value(F.col("_t.raw_amount"), rate, kind, F.col("context"))
    keep = [c for c in usage.columns if c not in ("prompt_tokens", "completion_tokens")]
    return rows.select(*keep, "_t.token_type", "_t.raw_amount", final.alias("rate"), value.alias("token_value"))


def running_balance(ledger: DataFrame, opening: float, bucket: Column) -> DataFrame:
    """Balance after each entry, never below zero; ``ledger`` is (user, ts, id, delta).

    Clamping at zero equals subtracting the deepest shortfall so far.
    """
    rows = scan.with_clamped(ledger, ["user"], ["ts", "id"], bucket, F.col("delta"), opening)
    return rows.withColumn("balance", F.col("raw") - F.least(F.lit(0.0), F.col("low"))).drop("raw", "low")


def final_balance(ledger: DataFrame, opening: float, bucket: Column) -> DataFrame:
    """Credits after the last entry of each user."""
    return (
        running_balance(ledger, opening, bucket)
        .groupBy("user")
        .agg(F.max_by("balance", F.struct("ts", "id")).alias("balance"))
    )


def add_interval(ts: Column, value: Column, unit: Column) -> Column:
    """Calendar addition; a day that the target month lacks runs over into the next month; unknown unit: unchanged."""
    months = F.add_months(F.trunc(ts, "month"), value.cast("int"))
    day_part = ts - F.date_trunc("day", ts)
    overflow = F.date_add(months, F.dayofmonth(ts) - 1).cast("timestamp_ntz") + day_part
    seconds = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
    out = F.when(unit == "months", overflow)
    for name, n in seconds.items():
        out = out.when(unit == name, ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (value * n).cast("decimal(18,6)")))
    return out.otherwise(ts)


def refill_due(balance: Column, cost: Column, enabled: Column, amount: Column, last: Column, next_at: Column, now: Column) -> Column:
    """Spending would exhaust the credits, refills are on and the interval has passed or none was made yet."""
    return (balance - cost <= 0) & enabled & (amount > 0) & (last.isNull() | (next_at <= now))
