"""Session defaults and the shared working folder.

On a cluster the session is the caller's; only the folder named by ``spark.checkpoint.dir`` is used for cut lineage
and intermediate tables. A local folder is created only in local mode, when that setting is empty, as in tests and the local bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("convolake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a fresh local one in local mode and an error elsewhere."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="convolake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


WRITTEN_ROUND = 3  # every how many rounds a loop of joins writes its rows


def cut_lineage(df: DataFrame, number: int = 0) -> DataFrame:
    """The rows, computed once in the shared folder and safe against the loss of executors: by a reliable checkpoint.

    A checkpoint keeps the size estimate of the plan behind it, and joins multiply such estimates: a loop of joins soon has
    numbers whose arithmetic alone takes minutes. Loops pass the ``number`` of the round, from 1; every third round is
    written as a table instead, which has the size of its files.
    """
    if not number or number % WRITTEN_ROUND:
        shared_folder(df.sparkSession)
        return df.checkpoint(eager=True)
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows over all cores when a scan yields fewer partitions than that; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The frame, computed once, with a broadcast hint if it has no more than ``rows`` rows; else as it is."""
    fixed = cut_lineage(df)
    return F.broadcast(fixed) if fixed.limit(rows + 1).count() <= rows else fixed
