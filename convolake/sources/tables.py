"""Access to the given parquet tables and the views the operators expect on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.functions.text import token_estimate

ROOT = -1  # parent of a first message in the integer-keyed message view


class Tables:
    """Lazy scans: ``tables.orders`` reads ``orders.parquet`` below the data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def messages(self) -> DataFrame:
        """Conversations as a message forest keyed by (conv_id, msg), with branches."""
        turn, conv = F.col("turn"), F.col("conv_id")
        parent = (
            F.when(turn == 0, F.lit(ROOT))
            .when(((conv + turn) % 5 == 0) & (turn >= 2), turn - 2)
            .otherwise(turn - 1)
        )
        return self.conversations.select(
            "conv_id",
            turn.alias("msg"),
            parent.cast("bigint").alias("parent"),
            "role",
            "text",
            message_time(conv, turn).alias("created_at"),
            token_estimate(F.col("text")).alias("tokens"),
            F.when(turn % 4 == 3, F.concat(F.lit("So far: "), "text")).alias("summary"),
        )

    def acl(self) -> DataFrame:
        """Grants on suppliers as resources: to a user, a group (nation) or everybody."""
        key = F.col("s_suppkey")
        return self.supplier.select(
            key.alias("resource_id"),
            F.when(key % 3 == 0, "user").when(key % 3 == 1, "group").otherwise("public").alias("principal_type"),
            F.when(key % 3 == 0, key * 7 % 1000)
            .when(key % 3 == 1, F.col("s_nationkey").cast("bigint"))
            .alias("principal_id"),
            (1 + key % 8).cast("int").alias("perm_bits"),
        )

    def usage(self) -> DataFrame:
        """Line items as usage rows of a model (the part's type) by a user (the supplier)."""
        return self.lineitem.join(
            self.part.select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("model")), "l_partkey"
        ).select(
            F.col("l_suppkey").alias("user"),
            F.col("l_orderkey").alias("conversation_id"),
            F.col("l_linenumber").alias("line"),
            "model",
            F.col("l_quantity").alias("prompt_tokens"),
            F.col("l_linenumber").cast("double").alias("completion_tokens"),
            F.when(F.col("l_returnflag") == "R", "incomplete").otherwise("message").alias("context"),
        )


def message_time(conv: Column, turn: Column) -> Column:
    return (
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        + F.make_dt_interval(F.lit(0), conv.cast("int"), F.lit(0))
        + F.make_dt_interval(F.lit(0), F.lit(0), turn.cast("int"))
    )


# The same views for the oracle queries.
MSG_SQL = """msg AS (
  SELECT conv_id, turn AS msg,
         CASE WHEN turn = 0 THEN -1 WHEN (conv_id + turn) % 5 = 0 AND turn >= 2 THEN turn - 2 ELSE turn - 1 END AS parent,
         role, text,
         TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(turn) AS created_at,
         CAST(ceil(len(string_split(text, ' ')) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS tokens,
         CASE WHEN turn % 4 = 3 THEN 'So far: ' || text END AS summary
  FROM conversations)"""
ACL_SQL = """acl AS (
  SELECT s_suppkey AS resource_id,
         CASE s_suppkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'group' ELSE 'public' END AS principal_type,
         CASE s_suppkey % 3 WHEN 0 THEN s_suppkey * 7 % 1000 WHEN 1 THEN s_nationkey END AS principal_id,
         CAST(1 + s_suppkey % 8 AS INTEGER) AS perm_bits
  FROM supplier)"""
USAGE_SQL = """usage AS (
  SELECT l_suppkey AS "user", l_orderkey AS conversation_id, l_linenumber AS line, lower(p_type) AS model,
         l_quantity AS prompt_tokens, CAST(l_linenumber AS DOUBLE) AS completion_tokens,
         CASE WHEN l_returnflag = 'R' THEN 'incomplete' ELSE 'message' END AS context
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
