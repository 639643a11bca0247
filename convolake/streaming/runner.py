"""Streaming plumbing: table streams, results by micro-batch, state carried between micro-batches.

Streams run with ``availableNow``. Everything a query keeps (checkpoint, results, carried state) lies in the shared
folder, and a repeated micro-batch overwrites its own files, so a restart gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.session import fresh_path


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream over ``{folder}/{name}.parquet``, a file or a folder of files."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_batches(stream: DataFrame, mode: str, step: Callable[[DataFrame, int], None], name: str, checkpoint: str | None = None) -> None:
    """Run to the end of the available data, one call of ``step`` per micro-batch; an earlier checkpoint is taken up again."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or fresh_path(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(step)
        .start()
    )
    query.awaitTermination()


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Append-only result through the exactly-once file sink."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", fresh_path(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


FOLD_ROWS = 512  # rows that a task turns into Python values at a time
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def run_folded(
    stream: DataFrame,
    order: list[str],
    fold: Callable[[tuple, tuple], tuple[tuple, tuple | None]],
    start: tuple,
    state: str,
    schema: str,
    name: str,
    hold: int | None = None,
    delay: int = 0,
) -> DataFrame:
    """The rows that a fold over the ordered rows of each ``key`` gives, with state carried from micro-batch to micro-batch.

    ``fold(state, row)`` gives the next state and a row of ``schema`` without its key, or none. Tasks fold their sorted rows in
    one pass, the carried state of a key first: a key costs no call, store or frame of its own, and its rows are never held
    together. With ``hold`` the stream has times ``us``: rows more than ``delay`` before the latest of earlier micro-batches are
    late and left out, and state ends ``hold`` after the last row of its key.
    """
    spark, out, ran = stream.sparkSession, fresh_path(stream.sparkSession, name), []
    states, results = ([tuple(c.split()) for c in shape.split(", ")] for shape in (state, schema))
    kept = [*results, *states, ("_last", "bigint"), ("_held", "boolean")]
    shape = ", ".join(map(" ".join, kept))
    values = [c for c in stream.columns if c not in ("key", "us")]

    def run(batch: DataFrame, number: int) -> None:
        time = F.lit(None) if hold is None else F.col("us")
        rows = batch.select("key", time.cast("bigint").alias("_last"), F.lit(False).alias("_held"), *values, *[F.lit(None).cast(t).alias(c) for c, t in states])
        over = None
        if number > 0:
            carried = spark.read.schema(shape).parquet(f"{out}/batch={number - 1}").filter("_held")
            latest = carried.agg(F.max("_last")).first()[0]
            if latest is not None:
                over = latest - delay
                rows = rows.filter(F.col("_last") >= over)
            rows = rows.unionByName(carried.select("key", "_last", "_held", *[c for c, _ in states]), allowMissingColumns=True)
        dealt = rows.repartition("key").sortWithinPartitions("key", F.desc("_held"), *order)
        folded = dealt.mapInArrow(lambda batches: _folded(batches, fold, start, kept, len(results) - 1, len(states), hold, over), shape)
        folded.write.mode("overwrite").partitionBy("_held").parquet(f"{out}/batch={number}")
        ran.append(number)

    run_batches(stream, "append", run, name)
    if not ran:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{shape}, batch int").parquet(out).filter("NOT _held").select(*[c for c, _ in results])


def _folded(
    batches: Iterator[pa.RecordBatch], fold: Callable, start: tuple, kept: list[tuple[str, str]], width: int, held: int, hold: int | None, over: int | None
) -> Iterator[pa.RecordBatch]:
    """Results and, behind the last row of a key, its state; rows are key, time, whether they are carried state, values, state."""
    met, now, last, state = False, None, None, start
    found: list[tuple] = []

    def end() -> None:
        if met and (over is None or last + hold >= over):
            found.append((now, *[None] * width, *state, last, True))

    def taken() -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [()] * len(kept)
        batch = pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, kept, strict=True)], names=[c for c, _ in kept])
        found.clear()
        return batch

    for batch in batches:
        for at in range(0, batch.num_rows, FOLD_ROWS):
            for key, us, carried, *rest in zip(*[c.to_pylist() for c in batch.slice(at, FOLD_ROWS).columns], strict=True):
                if not met or key != now:
                    end()
                    met, now, last, state = True, key, us, start
                if carried:
                    state = tuple(rest[-held:])
                    continue
                last = us if last is None else max(last, us)
                state, row = fold(state, tuple(rest[:-held]))
                if row is not None:
                    found.append((key, *row, *[None] * held, None, False))
            yield taken()
    end()
    yield taken()


def run_update(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Latest row per key of an updating aggregate; each micro-batch writes the rows it changed."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(stream, "update", write, name)
    values = [c for c in stream.columns if c not in keys]
    return (
        spark.read.parquet(out)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        .select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])
    )
