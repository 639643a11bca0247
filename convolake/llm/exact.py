"""Exact duplicates by a content sort, with DataFrame operations only.

Normalised texts are range-partitioned by sampled splitters (their first characters and a hash, so that the sample stays
small whatever the texts) and sorted inside their partitions by the whole text, so that equal texts are neighbours; a
window over neighbours compares whole texts and elects the row that stays. Texts with so many copies that
one task would get a large share (at least ``1 / hot_texts`` of all rows, hence no more than ``hot_texts`` such texts)
are left out of the sort: their copies are pre-aggregated where they are read and meet as one row per text and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import without_white, written

LEAD = 64  # characters of a text in a sampled splitter; the hash behind them parts texts with a common beginning
HOT_TEXTS = 10_000
HOT_LEAST = 1_000


def exact_groups(docs: DataFrame, hot_texts: int = HOT_TEXTS, hot_least: int = HOT_LEAST, carry: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and the columns named in ``carry``.

    Texts are equal if identical without white space (null counts as empty). Of equal texts the one with the most code
    points stays, then the smallest doc_id (null last); of rows that agree in all of this exactly one stays. An empty
    table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.length(text).alias("_points"),
        without_white(text).alias("_norm"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("_none")]).alias("_row"),
    ).withColumns({"_hash": F.xxhash64("_norm"), "_lead": F.substring("_norm", 1, LEAD)})

    total = docs.count()
    least = max(hot_least, -(-total // hot_texts))
    hot = written(rows.groupBy("_hash").count().filter(F.col("count") >= least).select("_hash"), "hot-texts")

    # The sort: every text that is not hot.
    order = (F.col("_points").desc(), F.col("doc_id").asc_nulls_last())
    group = Window.partitionBy("_lead", "_hash", "_norm")
    cold = (
        rows.join(F.broadcast(hot), "_hash", "left_anti")
        .repartitionByRange("_lead", "_hash")
        .withColumn("keep_id", F.first("doc_id").over(group.orderBy(*order)))
        .withColumn("_rank", F.row_number().over(group.orderBy(*order)))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .select("doc_id", "keep_id", "group_size", F.sha2("_norm", 256).alias("text_sha256"), "_rank", "_row")
    )

    # Hot texts: the best row of each, one partial result per text and task.
    many = (
        rows.join(F.broadcast(hot), "_hash", "left_semi")
        .withColumn("text_sha256", F.sha2("_norm", 256))
        .withColumn("_order", F.struct(-F.col("_points"), F.col("doc_id").isNull(), F.col("doc_id")))
        .drop("_norm", "_hash", "_lead")
    )
    best = written(
        many.groupBy("text_sha256").agg(
            F.min("_order").alias("_best"), F.min_by("doc_id", "_order").alias("keep_id"), F.count("*").alias("group_size")
        ),
        "hot-best",
    )
    met = many.join(F.broadcast(best), "text_sha256").withColumn("_first", F.col("_order") == F.col("_best"))
    fields = ["doc_id", "keep_id", "group_size", "text_sha256"]
    ties = Window.partitionBy("text_sha256").orderBy(F.lit(0))
    found = (
        cold.unionByName(met.filter(~F.col("_first")).select(*fields, F.lit(2).alias("_rank"), "_row"))
        .unionByName(met.filter("_first").withColumn("_rank", F.row_number().over(ties)).select(*fields, "_rank", "_row"))
    )
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("_rank") == 1).alias("kept"), "text_sha256", *[f"_row.{c}" for c in carry]
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    marked = exact_groups(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text"), carry=("_doc",))
    return marked.filter("kept").select("_doc.*")
