"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, (offset + i * skip) mod size. Shards take
turns: each claims the first slot of its order that is still free, until all are taken, so shard sizes differ by one
slot at most and a changed shard list moves few slots. A row's slot is a hash of its key; one broadcast join with the
table, whose rows are exactly `size` (16 bytes each), places it. Everything is DataFrame functions: nothing shuffles,
a hot source or group of copies spreads as its keys do, and a lost executor only repeats its own scan tasks.

A null key is placed as the empty string. Equal keys share a shard. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 20
#: A prime of about a hundred slots for each shard: shares differ by one slot, a hundredth, at most.
SIZE = 2003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(names: list[str], size: int = SIZE) -> list[int]:
    """The shard (index into `names`) of each slot; `size` must be a prime not below the number of shards."""
    if not names or size < len(names) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("a prime size and one shard at least are needed")
    offset = [_number(f"{n}/offset") % size for n in names]
    skip = [_number(f"{n}/skip") % (size - 1) + 1 for n in names]
    turn = [0] * len(names)
    table, left = [-1] * size, size
    while True:
        for shard in range(len(names)):
            slot = (offset[shard] + turn[shard] * skip[shard]) % size
            while table[slot] >= 0:
                turn[shard] += 1
                slot = (offset[shard] + turn[shard] * skip[shard]) % size
            table[slot] = shard
            turn[shard] += 1
            left -= 1
            if not left:
                return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: the first 32 bits of its MD5, modulo the table size."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % size).cast("int")


def table_frame(spark: SparkSession, names: list[str], size: int = SIZE) -> DataFrame:
    """slot, shard: the lookup table as `size` rows."""
    text = F.lit(",".join(map(str, lookup_table(names, size))))
    return spark.range(1).select(F.posexplode(F.split(text, ",")).alias("slot", "_s")).select("slot", F.col("_s").cast("int").alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, size: int = SIZE) -> DataFrame:
    """`df` with slot and shard of each row (replacing columns of these names)."""
    table = table_frame(df.sparkSession, [f"shard-{k:05d}" for k in range(shards)], size)
    return df.drop("shard").withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(table), "slot", "left")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, size: int = SIZE) -> None:
    """Rows of `df` under one folder per shard; many tasks write a large shard, none gathers one."""
    place(df, key, shards, size).drop("slot").write.partitionBy("shard").parquet(path)
