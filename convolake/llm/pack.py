"""Best-fit packing of documents into sequences of bounded length, in a hierarchy of partitions.

Pieces are dealt evenly over nodes of bounded size. A node packs its pieces best-fit, longest first. No two bins of a
node could be merged, so at most one is half empty or less, and only the emptiest can still take something: a node of
the tree hands up its ``fan_in + 1`` emptiest bins as items, everything else is final. A parent meets at most ``fan_in``
bins that are no more than half full, so no more than that many fuller bins of a child can gain from it; handing up the
emptiest loses nothing, and every node's work is bounded whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import id_and_text, slices, written
from convolake.llm.tokens import TextEncoder, merging_encoder

CAPACITY = 2048
NODE_ITEMS = 8192
FAN_IN = 16
ID_SHIFT = 32  # a bin's number: node, then place in the node

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole sequences but for the first."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row per piece of every document's ids (its tokens, then ``end_id``); with ``keep_ids`` the ids themselves too.

    A null or empty text is the end id alone; a null doc_id stays null; rows are independent of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(*merging_encoder(tokenizer_path))
        end = int(end_id).to_bytes(4, "little")
        for doc_ids, texts in slices(batches):
            rows = []
            for doc, ids in zip(doc_ids, encoder(texts), strict=True):
                ids += end
                for piece, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(part), part if keep_ids else None))
            doc, piece, start, length, crc, part = zip(*rows, strict=True)
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_ids:
                columns.append(pa.array(part, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return id_and_text(docs).mapInArrow(run, PIECE + (", ids binary" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length: longest first, each into the fullest bin that still takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    free_sizes = 0  # bit s: there is a bin with s free
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = free_sizes >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                free_sizes &= ~(1 << free)
        else:
            free, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        if left:
            open_bins[left].append(b)
            free_sizes |= 1 << left
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, node_items: int = NODE_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """``pieces`` (a column ``length`` of 1 to ``capacity``) with sequence_id and offset; other columns are kept.

    An empty table gives an empty result; equal rows are packed as items of their own.
    """
    spark = pieces.sparkSession
    count = pieces.count()
    nodes = max(1, -(-count // node_items))
    # Dealing by content and place spreads repeated rows as well.
    dealt = pieces.withColumn("_node", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "length"), F.lit(nodes)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity)
        used = np.bincount(bins, weights=pdf["length"].to_numpy()).astype(np.int64)
        up = np.zeros(len(used), bool)
        up[np.argsort(used, kind="stable")[: fan_in + 1]] = True
        up &= used < capacity
        node = int(pdf["_node"].iloc[0])
        return pdf.assign(_bin=(node << ID_SHIFT) + bins, offset=offsets, _used=used[bins], _up=up[bins])

    own = [f for f in dealt.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    packed = written(
        dealt.groupBy("_node").applyInPandas(fill, f"{schema}, _bin bigint, offset bigint, _used bigint, _up boolean"), "packed"
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit(pdf["_used"].to_numpy(), capacity)
        used = np.bincount(bins, weights=pdf["_used"].to_numpy()).astype(np.int64)
        host = np.empty(len(used), np.int64)
        first = offsets == 0
        host[bins[first]] = pdf["_bin"].to_numpy()[first]
        up = np.zeros(len(used), bool)
        up[np.argsort(used, kind="stable")[: fan_in + 1]] = True
        up &= used < capacity
        return pd.DataFrame({"_bin": pdf["_bin"], "_host": host[bins], "_shift": offsets, "_node": pdf["_node"], "_used": used[bins], "_up": up[bins]})

    # The tree: bins handed up become items; ``moved`` says where the bins of the first level are by now.
    items = packed.filter("offset = 0 AND _up").select("_bin", "_node", "_used")
    moved = None
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        met = written(
            items.withColumn("_node", F.floor(F.col("_node") / fan_in))
            .groupBy("_node")
            .applyInPandas(merge, "_bin bigint, _host bigint, _shift bigint, _node bigint, _used bigint, _up boolean"),
            "merged-bins",
        )
        step = met.select(F.col("_bin").alias("_from"), F.col("_host").alias("_next"), F.col("_shift").alias("_more"))
        if moved is None:
            moved = met.select("_bin", "_host", "_shift")
        else:
            moved = written(
                moved.join(step, F.col("_host") == F.col("_from"), "left").select(
                    "_bin", F.coalesce("_next", "_host").alias("_host"), (F.col("_shift") + F.coalesce("_more", F.lit(0))).alias("_shift")
                ),
                "moved-bins",
            )
        items = met.filter("_shift = 0 AND _up").select("_bin", "_node", "_used")
    if moved is None:
        moved = spark.createDataFrame([], "_bin bigint, _host bigint, _shift bigint")
    return (
        packed.join(moved, "_bin", "left")
        .withColumn("sequence_id", F.coalesce("_host", "_bin"))
        .withColumn("offset", F.col("offset") + F.coalesce("_shift", F.lit(0)))
        .drop("_bin", "_node", "_used", "_up", "_host", "_shift")
    )


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every document's pieces with their sequence and their offset in it."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
