"""Weighted rendezvous hashing of stable record keys over shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, session

#: Rows numbered together; a shard is cut into as many pieces as this needs.
ROWS_PER_PIECE = 4096


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's bid for a key: an exponential draw with the shard's weight as its rate. The least bid wins, so a
    shard wins in proportion to its weight, and bids of other shards never depend on how many there are."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("bid"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Struct (bid, shard) of the winning shard; shards of weight 0 get nothing. Ties go to the smaller shard."""
    bids = [draw(key, j, w) for j, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*bids))


def assign_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot and grown_shard.

    The key and the shard list alone decide the shard (law `key`); grown_shard is the shard if one more of weight
    grown_weight joined, so it is either `shard` or the new one. size is the text's UTF-8 bytes plus 8 (null: 8), and
    slot numbers a shard's rows from 0 without gaps, by pieces that are numbered on their own and then shifted; what is
    known of each row is written to the shared folder once, so texts are read once and both passes see the same pieces.
    Null texts count as empty; a null key falls back on the text's CRC. Repeated rows each get their own slot, and
    columns other than the two named are neither read nor returned. An empty table gives an empty result.
    """
    weights = [1.0] * n_shards if weights is None else list(weights)
    if len(weights) != n_shards:
        raise ValueError("one weight for each shard")
    spark = session(df)
    ws = Workspace(spark, "sharding")
    blank = F.coalesce(F.col(text), F.lit(""))
    stable = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\x00"), F.crc32(blank).cast("string")))
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(blank) + F.lit(8)).cast("long").alias("size"), F.crc32(blank).alias("text_crc32"), stable.alias("_stable"))
    rows = rows.withColumn("_won", rendezvous(F.col("_stable"), weights)).withColumn("shard", F.col("_won.shard"))
    grown = F.array_min(F.array("_won", draw(F.col("_stable"), n_shards, grown_weight)))["shard"] if grown_weight > 0 else F.col("shard")
    # Where a row stands in its input spreads rows of one key, and rows that repeat altogether, over pieces.
    spread = F.xxhash64("_stable", "text_crc32", F.monotonically_increasing_id())
    rows = ws.table(rows.select("doc_id", "size", "text_crc32", "shard", grown.alias("grown_shard"), spread.alias("_spread")), "rows")

    pieces = max(1, math.ceil(rows.count() / (n_shards * ROWS_PER_PIECE)))
    rows = rows.withColumn("_piece", F.pmod("_spread", F.lit(pieces)))
    heights = rows.groupBy("shard", "_piece").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = heights.select("shard", "_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_piece").orderBy("doc_id", "text_crc32", "size", "_spread")
    rows = rows.withColumn("_nth", F.row_number().over(order) - 1)
    return rows.join(starts, ["shard", "_piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_start") + F.col("_nth")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard")
    )
