"""Keyed state that ends with event time: pending requests, several rate limits at once, violation scores, growing texts.

Times are microseconds (``us``), so that results do not hang on a session's time zone. A processor gets the rows of a key
in a micro-batch (a few numbers each; their number is bounded by the trigger of the source), puts them in order and folds
them. Timers end the state of keys that nothing happens to any more. Looks at growing texts are folded by tasks over sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convolake.functions import fixed
from convolake.functions.chunks import last_separator
from convolake.operators import scan
from convolake.session import fresh_path
from convolake.streaming.runner import run_append, run_batches, run_folded

MINUTE = 60_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: Column | str) -> Column:
    """Microseconds of a time without zone since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Processors need the store that can hold several states and timers; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def processed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, delay: str = "10 minutes") -> DataFrame:
    """The rows that a processor gives for a stream with a column ``us``."""
    timed = stream.withColumn("_at", F.timestamp_micros("us")).withWatermark("_at", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")


def run_processed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, name: str, delay: str = "10 minutes") -> DataFrame:
    with state_store(stream.sparkSession):
        return run_append(processed(stream, keys, processor, schema, delay), name)


class Folding(StatefulProcessor):
    """Folds the ordered rows of a key into one state; a timer ``hold`` after the last row of a micro-batch ends it."""

    state_schema = ""
    order = ("us", "id")
    hold: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(list(self.order))
        state = self.state.get() if self.state.exists() else None
        state, found = self.fold(key, state, given)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        if self.hold is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state is not None:
                self.handle.registerTimer((int(given["us"].max()) + self.hold) // 1000 + 1)
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def fold(self, key, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


# Pending requests ---------------------------------------------------------------------------------------------------

PENDING_ROW = "key bigint, id bigint, pending int, denied boolean"


def pending_step(pending: int, changed: int, us: int, starts: bool, limit: int, hold: int) -> tuple[int, int, bool]:
    """(pending, time of the last change, denied) after one start or finish.

    A count that nothing has changed for ``hold`` is forgotten. A start at the limit is denied and changes nothing, the
    time of the last change included.
    """
    if pending and us - changed > hold:
        pending = 0
    if starts:
        return (pending, changed, True) if pending >= limit else (pending + 1, us, False)
    return (pending - 1, us, False) if pending else (0, changed, False)


class Pending(Folding):
    state_schema = "pending int, changed bigint"

    def __init__(self, limit: int = fixed.CONCURRENT_LIMIT, hold: int = MINUTE):
        self.limit, self.hold = limit, hold

    def fold(self, key, state, rows):
        pending, changed = state or (0, 0)
        out = []
        for us, ident, starts in zip(rows["us"], rows["id"], rows["starts"], strict=True):
            pending, changed, denied = pending_step(pending, changed, us, starts, self.limit, self.hold)
            out.append((key[0], ident, pending, denied))
        return (pending, changed) if pending else None, pd.DataFrame(out, columns=["key", "id", "pending", "denied"])


def stream_pending(moves: DataFrame, limit: int = fixed.CONCURRENT_LIMIT, hold: int = MINUTE) -> DataFrame:
    """(key, id, pending, denied) for a stream of (key, us, id, starts)."""
    return run_processed(moves, ["key"], Pending(limit, hold), PENDING_ROW, "pending")


def batch_pending(moves: DataFrame, limit: int = fixed.CONCURRENT_LIMIT, hold: int = MINUTE) -> DataFrame:
    """The same for a table. Rows of a key that follow a gap longer than ``hold`` start anew and go to other tasks."""
    spans = F.floor(F.col("us") / (60 * MINUTE))
    before = scan.with_previous(moves, ["key"], ["us", "id"], spans, {"_before": "us"})
    fresh = F.when(F.col("_before").isNull() | (F.col("us") - F.col("_before") > hold), 1).otherwise(0).cast("bigint")
    parts = scan.with_running(before.withColumn("_fresh", fresh), ["key"], ["us", "id"], spans, {"_part": ("sum", F.col("_fresh"))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pending, changed = None, 0, 0
        for pdf in batches:
            out = []
            for key, part, us, ident, starts in pdf.itertuples(index=False, name=None):
                if (key, part) != now:
                    now, pending, changed = (key, part), 0, 0
                pending, changed, denied = pending_step(pending, changed, us, starts, limit, hold)
                out.append((key, ident, pending, denied))
            yield pd.DataFrame(out, columns=["key", "id", "pending", "denied"])

    rows = parts.select("key", "_part", "us", "id", "starts").repartition("key", "_part").sortWithinPartitions("key", "_part", "us", "id")
    return rows.mapInPandas(run, PENDING_ROW)


# Rate limits --------------------------------------------------------------------------------------------------------

# Requests per window, width of the window in minutes and points of a request beyond the limit.
LIMITERS = [
    ("message", 40, 1, "message_limit", 1.0),
    ("login", 7, 5, "logins", 1.0),
    ("register", 5, 60, "registrations", 1.0),
]
DENIED_ROW = "limiter string, key_kind string, key string, id bigint, us bigint, user bigint, ip string, type string, score double, n bigint"
KEYS = ["limiter", "key_kind", "key"]


def limited(requests: DataFrame, limiters: list[tuple] | None = None) -> DataFrame:
    """A row per request, limiter and kind of key (user, ip) of (kind, us, id, user, ip); ``start`` is its window's.

    A request without user or without ip has no row for it.
    """
    rules = F.array(
        *[
            F.struct(F.lit(kind).alias("limiter"), F.lit(most).cast("bigint").alias("most"), F.lit(minutes * MINUTE).cast("bigint").alias("width"), F.lit(name).alias("type"), F.lit(score).alias("score"))
            for kind, most, minutes, name, score in limiters or LIMITERS
        ]
    )
    keys = F.array(F.struct(F.lit("user").alias("key_kind"), F.col("user").cast("string").alias("key")), F.struct(F.lit("ip").alias("key_kind"), F.col("ip").alias("key")))
    return (
        requests.withColumn("_rule", F.explode(F.filter(rules, lambda r: r["limiter"] == F.col("kind"))))
        .withColumn("_key", F.explode(F.filter(keys, lambda k: k["key"].isNotNull())))
        .select("_rule.*", "_key.*", "us", "id", "user", "ip")
        .withColumn("start", F.col("us") - F.pmod("us", "width"))
    )


def window_totals(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(limiter, key_kind, key, start, most, n) per window, of a table or of a stream.

    All limiters share one aggregate: state lies in windows of an hour, which every width divides, and goes with them.
    """
    keys = [*KEYS, "start", "most"]
    if not rows.isStreaming:
        return rows.groupBy(*keys).agg(F.count("*").alias("n"))
    timed = rows.withColumn("_at", F.timestamp_micros("us")).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", "60 minutes"), *keys).agg(F.count("*").alias("n")).drop("window")


def batch_denied(rows: DataFrame) -> DataFrame:
    """The requests beyond the limit of their window, with their number in it."""
    numbered = scan.with_number(rows, [*KEYS, "start"], ["us", "id"], F.floor(F.col("us") / MINUTE), "n")
    return numbered.filter(F.col("n") > F.col("most")).drop("most", "width", "start")


def run_carried(stream: DataFrame, step: Callable[[DataFrame, DataFrame | None, int], tuple[DataFrame, DataFrame]], schema: str, name: str, delay: int = 10 * MINUTE) -> DataFrame:
    """The rows that ``step(batch, carried, over)`` gives, beside the state to carry on, for each micro-batch.

    A hot key's rows stay in Spark's tables, where they are parted and sorted. Rows more than ``delay`` before the latest of
    earlier micro-batches are late and left out; no row before ``over`` comes any more, so state up to there can go.
    """
    spark, out, ran = stream.sparkSession, fresh_path(stream.sparkSession, name), []

    def run(batch: DataFrame, number: int) -> None:
        carried, latest = None, None
        if number > 0:
            carried = spark.read.parquet(f"{out}/state/v={number - 1}")
            latest = carried.agg(F.max("latest")).first()[0]
            if latest is not None:
                batch = batch.filter(F.col("us") >= latest - delay)
        last = max((x for x in (batch.agg(F.max("us")).first()[0], latest) if x is not None), default=0)
        rows, state = step(batch, carried, last - delay)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        state.withColumn("latest", F.lit(last).cast("bigint")).write.mode("overwrite").parquet(f"{out}/state/v={number}")
        ran.append(number)

    run_batches(stream, "append", run, name)
    return spark.read.schema(schema).parquet(f"{out}/rows").drop("batch") if ran else spark.createDataFrame([], schema)


def stream_denied(rows: DataFrame) -> DataFrame:
    """The same for a stream; the counts of windows that are not over are carried from micro-batch to micro-batch."""
    window = [*KEYS, "start"]

    def step(batch: DataFrame, carried: DataFrame | None, over: int) -> tuple[DataFrame, DataFrame]:
        numbered = scan.with_number(batch, window, ["us", "id"], F.floor(F.col("us") / MINUTE), "n")
        counts = batch.groupBy(*window, "width").agg(F.count("*").alias("held"))
        if carried is not None:
            numbered = numbered.join(carried.select(*window, "held"), window, "left").withColumn("n", F.col("n") + F.coalesce("held", F.lit(0)))
            counts = counts.unionByName(carried.drop("latest")).groupBy(*window, "width").agg(F.sum("held").alias("held"))
        denied = numbered.filter(F.col("n") > F.col("most")).withColumn("n", F.col("n").cast("bigint"))
        return denied.select(*[c.split()[0] for c in DENIED_ROW.split(", ")]), counts.filter(F.col("start") + F.col("width") > over)

    return run_carried(rows.drop("_at"), step, DENIED_ROW, "denied")


# Violations ---------------------------------------------------------------------------------------------------------

BAN_ROW = "user bigint, ip string, type string, id bigint, limiter string, key_kind string, us bigint, score double"


def ban_rows(crossed: DataFrame, minutes: int = fixed.BAN_MINUTES) -> DataFrame:
    """A ban for the user and, where the request has one, for its address: (key_kind, key, user, type, starts, expires, score)."""
    keys = F.array(F.struct(F.lit("user").alias("kind"), F.col("user").cast("string").alias("key")), F.struct(F.lit("ip").alias("kind"), F.col("ip").alias("key")))
    return crossed.withColumn("_key", F.explode(F.filter(keys, lambda k: k["key"].isNotNull()))).select(
        F.col("_key.kind").alias("key_kind"), F.col("_key.key").alias("key"), "user", "type", "id", F.col("us").alias("starts"), (F.col("us") + minutes * MINUTE).alias("expires"), "score"
    )


def batch_bans(denied: DataFrame, interval: int = fixed.BAN_INTERVAL, minutes: int = fixed.BAN_MINUTES) -> DataFrame:
    order = ["us", "id", "limiter", "key_kind"]
    scored = scan.with_running(denied.filter(F.col("user").isNotNull()), ["user", "type"], order, F.floor(F.col("us") / (60 * MINUTE)), {"total": ("sum", F.col("score"))})
    crossed = scored.filter(F.floor((F.col("total") - F.col("score")) / interval) < F.floor(F.col("total") / interval))
    return ban_rows(crossed.withColumn("score", F.col("total")), minutes)


def stream_bans(denied: DataFrame, interval: int = fixed.BAN_INTERVAL, minutes: int = fixed.BAN_MINUTES) -> DataFrame:
    """The same for a stream; the points of each user and type are carried."""
    order, key = ["us", "id", "limiter", "key_kind"], ["user", "type"]

    def step(batch: DataFrame, carried: DataFrame | None, over: int) -> tuple[DataFrame, DataFrame]:
        scored = scan.with_running(batch, key, order, F.floor(F.col("us") / MINUTE), {"total": ("sum", F.col("score"))})
        points = batch.groupBy(*key).agg(F.sum("score").alias("held"))
        if carried is not None:
            scored = scored.join(carried.select(*key, "held"), key, "left").withColumn("total", F.col("total") + F.coalesce("held", F.lit(0.0)))
            points = points.unionByName(carried.drop("latest")).groupBy(*key).agg(F.sum("held").alias("held"))
        crossed = scored.filter(F.floor((F.col("total") - F.col("score")) / interval) < F.floor(F.col("total") / interval))
        return crossed.withColumn("score", F.col("total")).select(*[c.split()[0] for c in BAN_ROW.split(", ")]), points

    return ban_rows(run_carried(denied.filter(F.col("user").isNotNull()), step, BAN_ROW, "bans"), minutes)


# Growing texts ------------------------------------------------------------------------------------------------------

# Looks without a text or without a change after which a text is given up, and the least growth worth a chunk.
MAX_MISSING, MAX_UNCHANGED, MIN_GROWTH = 6, 10, 20
LOOK_ROW = "key string, seq int, chunk string, outcome string"


def look(sent: int, missing: int, unchanged: int, text: str | None, complete: bool) -> tuple[int, int, int, str | None, str | None]:
    """(sent, missing, unchanged, chunk, outcome) after one look; the text is done with once the outcome is not ``chunk``.

    A look at a text that is not there counts as missing, one that finds nothing new as unchanged. At least MIN_GROWTH
    new characters go out up to their last separator, all of them without one; a complete text goes out to its end.
    """
    if text is None:
        missing += 1
        return sent, missing, unchanged, None, "missing" if missing >= MAX_MISSING else None
    rest = text[sent:]
    if not rest:
        unchanged += 1
    if complete:
        return len(text), missing, unchanged, rest.strip() or None, "finished"
    if len(rest) >= MIN_GROWTH:
        mark = last_separator(rest)
        chunk = rest[: mark + 1] if mark >= 0 else rest
        return sent + len(chunk), missing, unchanged, chunk, "chunk"
    return sent, missing, unchanged, None, "unchanged" if unchanged >= MAX_UNCHANGED else None


def next_look(state: tuple[int, int, int, bool], row: tuple[int, str | None, bool]) -> tuple[tuple, tuple | None]:
    """(sent, missing, unchanged, done) after one look (seq, text, complete), and (seq, chunk, outcome) if it had an outcome."""
    *counts, done = state
    seq, text, complete = row
    if done:
        return state, None
    *counts, chunk, outcome = look(*counts, text, complete)
    return (*counts, outcome not in (None, "chunk")), (seq, chunk, outcome) if outcome else None


def stream_looks(looks: DataFrame, hold: int = 5 * MINUTE, delay: str = "10 minutes") -> DataFrame:
    """(key, seq, chunk, outcome) for a stream of looks (key, us, seq, text, complete).

    State ends ``hold`` after the last look at a text, whether it was finished, given up or left.
    """
    state = "sent int, missing int, unchanged int, done boolean"
    rows = looks.select("key", "us", "seq", "text", "complete")
    return run_folded(rows, ["seq", "_last"], next_look, (0, 0, 0, False), state, LOOK_ROW, "looks", hold, int(pd.Timedelta(delay) // pd.Timedelta("1us")))
