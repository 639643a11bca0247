"""Rate limits, pending-request gauges, violation scores and bans: batch forms and their streaming twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions.fixed import BAN_INTERVAL, BAN_MINUTES
from convolake.operators import scan
from convolake.session import fresh_path
from convolake.streaming.runner import run_batches, run_update


def window_counts(events: DataFrame, key: str, width: str, watermark: str = "10 minutes") -> DataFrame:
    """(start, key, n) per tumbling window; works on a table and on a stream (state is dropped behind the watermark)."""
    timed = events.withColumn("_ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", watermark)
    return (
        timed.groupBy(F.window("_ts", width).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), key, "n")
    )


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.filter(F.col("n") > limit).withColumn("excess", F.col("n") - limit)


def stream_over_limit(events: DataFrame, key: str, width: str, limit: int) -> DataFrame:
    return over_limit(run_update(window_counts(events, key, width), ["start", key], "rate-limit"), limit)


def clamped_ledger(batch: DataFrame, bucket: Column, carried: DataFrame | None = None) -> DataFrame:
    """Running value per key that never falls below zero, with ``raw`` and ``low`` to carry on.

    ``batch`` is (key, ts, id, delta); ``carried`` (key, raw, low) is where earlier rows ended.
    """
    rows = scan.with_clamped(batch, ["key"], ["ts", "id"], bucket, F.col("delta"))
    if carried is not None:
        before = carried.select("key", F.col("raw").alias("_raw"), F.col("low").alias("_low"))
        base = F.coalesce("_raw", F.lit(0.0))
        rows = rows.join(before, "key", "left").withColumns(
            {"raw": F.col("raw") + base, "low": F.least(F.coalesce("_low", F.lit(0.0)), F.col("low") + base)}
        )
    low = F.least(F.lit(0.0), F.col("low"))
    return rows.select(*batch.columns, "raw", low.alias("low")).withColumn("value", F.col("raw") - F.col("low"))


def stream_ledger(stream: DataFrame, bucket: Column, name: str) -> DataFrame:
    """The same over a stream: one small row of state per key is carried from micro-batch to micro-batch."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)

    def step(batch: DataFrame, number: int) -> None:
        carried = spark.read.parquet(f"{out}/state/v={number - 1}") if number > 0 else None
        rows = clamped_ledger(batch, bucket, carried)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        rows = spark.read.parquet(f"{out}/rows/batch={number}")
        ends = rows.groupBy("key").agg(
            F.max_by("raw", F.struct("ts", "id")).alias("raw"), F.min("low").alias("low")
        )
        if carried is not None:
            ends = ends.unionByName(carried.join(ends, "key", "left_anti"))
        ends.write.mode("overwrite").parquet(f"{out}/state/v={number}")

    run_batches(stream, "append", step, name)
    return spark.read.parquet(f"{out}/rows").drop("batch")


def crossings(scored: DataFrame, interval: int = BAN_INTERVAL, minutes: int = BAN_MINUTES) -> DataFrame:
    """Ban events: rows at which the running score enters a new multiple of the interval.

    ``scored`` is (key, ts, id, delta, value) with ``value`` the running score.
    """
    before, now = F.floor((F.col("value") - F.col("delta")) / interval), F.floor(F.col("value") / interval)
    return scored.filter(before < now).select(
        "key", "id", F.col("ts").alias("starts"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).alias("expires"),
        F.col("value").alias("score"),
    )


def banned(requests: DataFrame, bans: DataFrame, hours: int = BAN_MINUTES // 60) -> DataFrame:
    """Requests inside a ban of their key: ``starts <= ts < expires``.

    Each ban is entered under every hour it touches, so requests meet only the bans of their own hour.
    """
    slots = bans.select(
        "key", "starts", "expires",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(hours)), lambda h: F.date_trunc("hour", F.col("starts")) + F.make_dt_interval(F.lit(0), h))).alias("slot"),
    )
    timed = requests.withColumn("slot", F.date_trunc("hour", "ts"))
    inside = (
        timed.join(slots, ["key", "slot"])
        .filter((F.col("ts") >= F.col("starts")) & (F.col("ts") < F.col("expires")))
        .groupBy("id")
        .agg(F.max("expires").alias("banned_until"))
    )
    return requests.join(inside, "id")


