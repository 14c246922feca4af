"""Sharding by jump consistent hashing (Lamping and Veach): keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, materialise, running_offsets

#: The multiplier of the generator that the jump hash is defined with.
JUMP_MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; with one shard more, keys stay or move to the new shard."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    at = np.zeros(len(key), np.int64)
    while len(live):
        out[live] = at
        key = key * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        draw = (key >> np.uint64(33)).astype(np.float64) + 1.0
        at = ((at + 1).astype(np.float64) * (float(1 << 31) / draw)).astype(np.int64)
        go = at < shards
        live, key, at = live[go], key[go], at[go]
    return out


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of each 64-bit key, from 0; keys must not be null (hash them first)."""
    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy().view(np.uint64), shards).astype(np.int32))

    return shard(key)


def shard_rows(df: DataFrame, key: list[str], shards: int, text_col: str = "text", overhead: int = 16, buckets: int = 1024) -> DataFrame:
    """Each row's key columns with size, text_crc32, law, shard, slot and grown_shard.

    The shard depends on the key and the number of shards alone (xxhash64 of the key columns,
    null included, then jump hash), so all rows of a key share a shard. Slots count from 0
    without gaps in each shard; they follow hash buckets, so no task numbers a whole shard.
    Rows of equal key, size and checksum take neighbouring slots in any order. A null text has
    size `overhead` and checksum 0. An empty table gives no rows.
    """
    small = df.select(*key, (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + overhead).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"))
    hashed = small.withColumn("_key", F.xxhash64(*key))
    placed = hashed.withColumn("shard", jump_shard(F.col("_key"), shards)).withColumn("grown_shard", jump_shard(F.col("_key"), shards + 1))
    placed = materialise(placed.withColumn("_bucket", bucket_of("_key", buckets=buckets)), "shard-keys")  # read twice below
    order = [F.col("_key"), *[F.col(k) for k in key], F.col("size"), F.col("text_crc32")]
    slotted = running_offsets(placed, "shard", "_bucket", order, F.lit(1), "slot")
    return slotted.select(*key, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, key: list[str], shards: int, path: str) -> None:
    """Write whole rows as Parquet, one folder a shard; large shards get several files."""
    keyed = df.withColumn("_shard", jump_shard(F.xxhash64(*key), shards))
    keyed.repartition(F.col("_shard"), F.pmod(F.xxhash64(*key), F.lit(64))).write.partitionBy("_shard").parquet(path)
