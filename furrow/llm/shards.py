"""Sharding by jump consistent hashing.

The shard is a function of the key and the number of shards alone: no ring
table, and when a shard is appended, a row either stays or moves into it.
Slots number the rows of a shard without a gap: rows fall by hash of id, size
and checksum into blocks, so rows of one id are divided too,
a window numbers each block, and the blocks' counts are added up. No task holds
a whole shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType

from furrow.llm.common import checkpoint

SHARDS = 16
#: Blocks a shard is numbered in; SHARDS * BLOCKS rows of counts are broadcast.
BLOCKS = 1024
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key among ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    bucket = np.zeros(len(state), np.int64)  # next candidate; accepted while below shards
    while len(going):
        shard[going] = bucket[going]
        with np.errstate(over="ignore"):
            state[going] = state[going] * _STEP + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
        bucket[going] = np.floor((shard[going] + 1) * (2147483648.0 / draw)).astype(np.int64)
        going = going[bucket[going] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a row; ``key`` is any column (hashed first), also null."""

    @F.pandas_udf(IntegerType())
    def pick(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(np.int64), shards))

    return pick(F.xxhash64(key))


def assign(
    df: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocks: int = BLOCKS,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1, crc32 0), and
    ``grown_shard`` the shard once another one is appended. A null id is a key
    like any other. Rows with equal ids share their shard; size and checksum
    spread them over its blocks. An empty table gives no rows; other columns are
    ignored.
    """
    raw = F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b""))
    keyed = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    rows = checkpoint(
        keyed.withColumns({
            "shard": shard_of(F.col("doc_id"), shards),
            "grown_shard": shard_of(F.col("doc_id"), shards + 1),
            "block": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(blocks)).cast("int"),
        })
    )
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    # at most shards * blocks short rows
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard",
        )
    )
