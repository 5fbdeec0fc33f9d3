"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, few rows move when shards are added."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from expogrid.llm.common import keyed

#: Multiplier of the published generator.
STEP = 2862933555777941757


def stable_key(column: Column) -> Column:
    """60 bits of the MD5 of the key as text; a null key counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every key among ``shards``; each round moves the keys that still jump, at most ``shards`` rounds."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at, shard = np.arange(len(state)), np.zeros(len(state), np.int64)
    with np.errstate(over="ignore"):
        state = state * np.uint64(STEP) + np.uint64(1)
        while len(at):
            draw = ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            following = ((shard[at] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            jumps = following < shards
            at, state = at[jumps], state[jumps] * np.uint64(STEP) + np.uint64(1)
            shard[at] = following[jumps]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards))

    return place(key)


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", blocks: int = 4096) -> DataFrame:
    """One row per document: its shard, its place in the shard, and its shard if one more were appended.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard. Only keys, sizes and
    checksums leave the scan; texts are not shuffled. Slots run from 0 without gaps, by stable key, id, size and
    checksum. They are numbered in ``blocks`` equal ranges of the hashed key for each shard, whose totals are then
    summed, so no task orders a whole shard. Rows alike in all of these are counted before the shuffle and numbered
    together: a key that a third of all rows share costs one row for each task.

    A null id is hashed as an empty text and keeps its null; a null text has no bytes (size 16, checksum 0).
    No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    columns = ["doc_id", "size", "text_crc32"]
    rows = keyed(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    alike = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("key", stable_key(F.col("doc_id")))
    placed = alike.withColumn("shard", shard_of(F.col("key"), shards)).withColumn("grown_shard", shard_of(F.col("key"), shards + 1))
    placed = placed.withColumn("block", F.floor(F.col("key") / F.lit((1 << 60) // blocks)).cast("int"))
    totals = placed.groupBy("shard", "block").agg(F.sum("n").alias("in_block"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("key", *columns).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    numbered = placed.join(starts, ["shard", "block"]).withColumn("first", first)
    return numbered.select(*columns, F.lit("key").alias("law"), "shard", "grown_shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot")).select(*columns, "law", "shard", "slot", "grown_shard")
