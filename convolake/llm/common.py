"""Helpers of the pipeline operators: written intermediate tables and bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.session import fresh_path

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WHITE_CLASS = r"[\x20\x09-\x0D]"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe against lost executors, lineage cut."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the text operators read; a null text is empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def without_white(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(text)


def slices(batches: Iterable[pa.RecordBatch], size: int = 4_000_000, rows: int = 512) -> Iterator[list[list]]:
    """Column lists of consecutive rows: at most ``rows`` rows, and few enough that texts (last column) stay near ``size``."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.column(batch.num_columns - 1).slice(at, n).nbytes > size:
                n = max(1, n // 4)
            part = batch.slice(at, n)
            yield [c.to_pylist() for c in part.columns]
            at += n


def met(rows: DataFrame, table: DataFrame, keys: list[str], crowd: str, hot: int = 10_000, least: int = 1_000) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row per key and in ``crowd`` the number of rows that meet it.

    Keys with at least one row in ``hot``, hence no more than ``hot`` of them, are broadcast; so no task gets the rows of
    a hot key.
    """
    total = table.agg(F.sum(crowd)).first()[0] or 0
    many = F.col(crowd) >= max(least, -(-total // hot))
    often, seldom = F.broadcast(table.filter(many).drop(crowd)), table.filter(~many).drop(crowd)
    rest = rows.join(often.select(*keys), keys, "left_anti").join(seldom, keys, "left")
    return rest.unionByName(rows.join(often, keys))
