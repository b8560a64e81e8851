"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Equal texts are one group; a group that exceeds ``PIECE_ROWS`` rows, or a fixed share of a shard in bytes or tokens, is
split into pieces of about that size, so a hot group neither fills a shard nor a task.  Pieces have a vector (bytes, tokens, rows).  A block of pieces is packed in
one task, largest share first, each where the dot product with the residual capacity is highest.  The shards of all
blocks are then items of the next level, where those of one block go to different shards, and so on until one block
is left: every level has 1/256 of the items of the one below, so the levels grow with the logarithm of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.bounds import broadcast_if_small
from ..plans.lineage import delete_table, written_table
from .mixing import words_in

SHARDS = 16
PIECE_ROWS = 256
#: A piece of several rows holds at most about 1/16 of a shard's bytes and tokens.
PIECES_PER_SHARD = 16
#: Pieces packed in one task.
BLOCK_ITEMS = 4_096
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (1.0, 1.0, 1.0)
MEASURES = ["bytes", "tokens", "rows"]


def pack_block(measures: np.ndarray, shards: int, families: np.ndarray | None = None, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Shard of every item (rows: items in a fixed order, columns: bytes, tokens, rows).

    Measures are taken as shares of the block; every shard starts with the same capacity.  Items of one family (the
    shards of one lower block, which are nearly equal) go to different shards, so that no shard gets one more of
    them than another; larger families come first.
    """
    totals = np.maximum(measures.sum(axis=0), 1e-12)
    shares = measures / totals * np.asarray(weights)
    _, family = np.unique(np.arange(len(measures)) if families is None else families, return_inverse=True)
    largest = shares.max(axis=1)
    residual = np.tile(np.asarray(weights) / shards, (shards, 1))
    placed = np.zeros(len(measures), dtype=np.int64)
    used, last = np.zeros(shards, dtype=bool), -1
    for i in np.lexsort((np.arange(len(measures)), -largest, family, -np.bincount(family, weights=largest)[family])).tolist():
        if family[i] != last:
            used[:], last = False, family[i]
        fit = residual @ shares[i]
        fit[used] = -np.inf
        best = placed[i] = int(fit.argmax())
        residual[best] -= shares[i]
        used[best] = True
    return placed


def _packed(items: DataFrame, shards: int, level: int, block_items: int) -> tuple[DataFrame, int]:
    """item, bin, offset (rows of the bin before the item) and the measures; number of blocks.

    Above the first level an item is block * shards + shard of the level below.
    """
    blocks = max(1, -(-items.count() // block_items))

    def pack(held: pa.Table) -> pa.Table:
        held = held.sort_by("item")
        measures = np.column_stack([held[m].to_numpy() for m in MEASURES]).astype(float)
        items = held["item"].to_numpy()
        placed = pack_block(measures, shards, items // shards if level else None)
        rows = held["rows"].to_numpy()
        offset = np.zeros(len(rows), dtype=np.int64)
        for shard in range(shards):
            own = placed == shard
            offset[own] = np.cumsum(rows[own]) - rows[own]
        bins = held["block"].to_numpy() * shards + placed
        return pa.table({"item": held["item"], "bin": pa.array(bins, pa.int64()), "offset": pa.array(offset, pa.int64()), **{m: held[m] for m in MEASURES}})

    family = F.floor(F.col("item") / shards) if level else F.col("item")
    dealt = items.withColumn("block", F.pmod(F.xxhash64(family, F.lit(level)), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(pack, "item bigint, bin bigint, offset bigint, bytes bigint, tokens bigint, rows bigint"), blocks


def place_items(items: DataFrame, shards: int = SHARDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item, shard, offset for rows (item, bytes, tokens, rows): offsets are gapless in every shard."""
    levels = []
    while True:
        packed, path = written_table((made := _packed(items, shards, len(levels), block_items))[0])
        levels.append((packed, path))
        if made[1] == 1:
            break
        items = packed.groupBy(F.col("bin").alias("item")).agg(*[F.sum(m).alias(m) for m in MEASURES])
    placed = levels.pop()[0].select("item", F.col("bin").alias("shard"), "offset")
    while levels:
        above = placed.select(F.col("item").alias("bin"), "shard", F.col("offset").alias("_before"))
        placed = levels.pop()[0].join(broadcast_if_small(above), "bin").select("item", "shard", (F.col("offset") + F.col("_before")).alias("offset"))
    return placed


def pack_shards(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = SHARDS, piece_rows: int = PIECE_ROWS, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, tokens, rows of its group, shard and slot (gapless from 0 in a shard).

    size is the UTF-8 length of the text plus 1.  A null text counts as an empty one, in size, checksum and group.
    Repeated rows get a slot each and are dealt by their number among equal ones, null keys likewise; an empty table
    gives no rows; with fewer documents than shards some shards stay empty.  The placement depends on the rows alone,
    so reruns agree.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(held) + 1).cast("bigint").alias("size"), F.crc32(held.cast("binary")).alias("text_crc32"),
        words_in(F.col(text)).alias("tokens"), F.xxhash64(held).alias("text_hash"),
    )
    # Equal rows are counted and dealt out again with a number each, so that none of them is told from another by its place.
    numbered = rows.groupBy(*rows.columns).count().withColumn("_number", F.explode(F.sequence(F.lit(1), F.col("count")))).drop("count")
    rows, path = written_table(numbered)
    group = ["text_hash", "text_crc32", "size", "tokens"]
    totals = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    share = [F.floor(F.lit(totals[m] / (shards * PIECES_PER_SHARD)) / F.greatest(F.col(m), F.lit(1))) for m in ("size", "tokens")]
    most = F.greatest(F.lit(1), F.least(F.lit(piece_rows), share[0], F.when(F.col("tokens") > 0, share[1])))
    large = rows.groupBy(*group).count().withColumn("pieces", F.ceil(F.col("count") / most)).where("pieces > 1").drop("count")
    split = rows.join(broadcast_if_small(large), group, "left")
    piece = F.pmod(F.xxhash64("doc_id", "_number"), F.coalesce("pieces", F.lit(1)))
    split = split.withColumn("item", F.xxhash64("text_hash", "text_crc32", "size", piece)).drop("text_hash", "pieces", "_number")
    items = split.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    placed = place_items(items, shards, block_items)
    order = Window.partitionBy("item").orderBy("doc_id", "text_crc32", "size")
    numbered = split.withColumn("_in_piece", F.row_number().over(order) - 1)
    return numbered.join(placed, "item").select(
        "doc_id", "size", "text_crc32", "tokens", F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("_in_piece")).alias("slot")
    )


def write_shards(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write the documents, with their columns, to one folder per shard; ids must be unique and not null."""
    placed = pack_shards(docs, key=key, text=text, shards=shards).select(F.col("doc_id").alias(key), "shard", "slot")
    docs.join(placed, key).write.partitionBy("shard").parquet(folder)
