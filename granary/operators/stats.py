"""Figures of a file system: extended statistics, capacity projection, cache usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.relational import beside
from granary.plans.schema import Tables

TIB = 1 << 40


def extended_stats(t: Tables) -> DataFrame:
    """Entries, inodes, objects, total, de-duplicated and stored size, and the shares they make; one row."""
    o = t.objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("dedup_size"), F.coalesce(F.sum(F.when(F.col("phys_size") > 0, F.col("phys_size"))), F.lit(0)).alias("stored_size"))
    i = t.inodes.agg(F.count("*").alias("inodes"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    c = t.contents.agg(F.count("*").alias("entries"))
    row = beside(o, i, c)
    return row.select("entries", "inodes", "objects", "total_size", "dedup_size", "stored_size", percent("dedup_size", "total_size").alias("dedup_pct"), percent("stored_size", "total_size").alias("stored_pct"), percent("stored_size", "dedup_size").alias("compression_pct"))


def stats_record(t: Tables, cache: DataFrame | None = None, database_bytes: int = 0, queued: int = 0) -> DataFrame:
    """The twelve figures of a statistics record: tables, database, cache (bytes, dirty) and objects queued for removal; one row."""
    figures = extended_stats(t).select("entries", "objects", "inodes", F.col("total_size").alias("fs_size"), "dedup_size", F.col("stored_size").alias("compr_size"))
    zero = F.lit(0).cast("long")
    used = cache_usage(cache, "bytes", F.col("dirty")) if cache is not None else t.inodes.sparkSession.range(1).select(*[zero.alias(c) for c in ("entries", "bytes", "dirty_entries", "dirty_bytes")])
    used = used.select(F.col("entries").alias("cache_entries"), F.col("bytes").alias("cache_size"), F.col("dirty_entries").alias("cache_dirty_entries"), F.col("dirty_bytes").alias("cache_dirty_size"))
    both = beside(figures, used).withColumns({"db_size": F.lit(database_bytes).cast("long"), "removals": F.lit(queued).cast("long")})
    return both.select("entries", "objects", "inodes", "fs_size", "dedup_size", "compr_size", "db_size", "cache_entries", "cache_size", "cache_dirty_entries", "cache_dirty_size", "removals")


def percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole)).otherwise(0.0)


def capacity(objects: DataFrame, inodes: DataFrame, length: str = "length") -> DataFrame:
    """Block size, blocks, free blocks, inode totals as a file system reports them; one row."""
    o = objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum(length), F.lit(0)).alias("size"))
    n = inodes.agg(F.count("*").alias("inodes"))
    block = F.when(F.col("objects") > 0, F.greatest(F.lit(4096), F.expr("size div objects"))).otherwise(F.lit(4096))
    sized = beside(o, n).withColumn("block_size", block.cast("long")).withColumn("total", F.greatest(2 * F.col("size"), F.lit(TIB)))
    return sized.select("block_size", F.expr("total div block_size").alias("blocks"), F.expr("(total - size) div block_size").alias("free_blocks"), F.greatest(2 * F.col("inodes"), F.lit(1_000_000)).alias("inode_total"), (F.greatest(2 * F.col("inodes"), F.lit(1_000_000)) - F.col("inodes")).alias("inodes_free"))


def cache_usage(cache: DataFrame, size: str, dirty: Column, by: list[str] | None = None) -> DataFrame:
    """Entries, bytes, dirty entries and dirty bytes."""
    return cache.groupBy(*(by or [])).agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(dirty).alias("dirty_entries"), F.coalesce(F.sum(F.when(dirty, F.col(size))), F.lit(0)).alias("dirty_bytes"))


def attribute_columns(inodes: DataFrame) -> DataFrame:
    """What stat() adds to an inode: 512-byte blocks and the number of links."""
    return inodes.withColumn("st_blocks", F.expr("(size + 511) div 512")).withColumn("st_nlink", F.col("refcount"))
