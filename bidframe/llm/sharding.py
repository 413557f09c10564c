"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf

#: Fixed value of the published algorithm: the multiplier of its generator.
JUMP_MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, for all keys at once. Going from n to n + 1 shards moves about 1 key in n + 1, each to shard n."""
    key = keys.astype(np.uint64)
    at = np.full(len(key), -1, dtype=np.int64)
    to = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = to[live]
        key[live] = key[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        step = (1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        to[live] = np.floor((at[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[to[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """``jump_hash`` of an integer column; a null key counts as 0."""

    @pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(ids.fillna(0).to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(F.coalesce(key, F.lit(0).cast("long")))


def key_number(docs: DataFrame, key: str) -> Column:
    """The number that is hashed for a key: the key itself if it is of an integer type, else the XXH64 of its text; null without one."""
    if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.col(key).cast("long")
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Give every document a shard and a slot in it.

    Law ``key``: the key and the shard count alone decide the shard, so no ring or table is kept, and one more shard
    takes rows only into itself. Slots of a shard run from 0 without gaps in the order of ``part`` (four hex digits
    of the key's md5) and then key; they are numbered part by part, with the parts' offsets from one small count.

    A null text has no bytes and crc32 0; a null key is hashed as 0, and one that is no integer by its text. Rows that repeat a key share its shard and get
    slots of their own. An empty table gives an empty result. Other columns of the input aren't looked at.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("~"))), 1, 4), 16, 10).cast("int").alias("part"),
        key_number(docs, key).alias("number"),
    ).select("*", jump_shard(F.col("number"), shards).alias("shard"), jump_shard(F.col("number"), shards + 1).alias("grown_shard"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = W.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(place) - 1)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", folder: str = "shard", files: int = 8) -> None:
    """Write all columns of ``docs`` as parquet, in one folder ``<folder>=<number>`` per shard.

    Rows of a shard are dealt to ``files`` files by a hash of the key, so no task holds a shard, and a task doesn't
    write a little into every one. A null key counts as 0; rows that repeat a key go to one file; null and empty texts
    are written as they are. An empty table writes no folder. A column that is called ``folder`` is an error, as the
    folder's name would hide it.
    """
    if folder in docs.columns:
        raise ValueError(f"{folder} is a column of the table; name another folder")
    rows = docs.withColumn(folder, jump_shard(key_number(docs, key), shards))
    rows.repartition(shards * files, folder, F.pmod(F.xxhash64(key), F.lit(files))).write.partitionBy(folder).parquet(path)
