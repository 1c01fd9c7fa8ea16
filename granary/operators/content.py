"""Content as fixed-size blocks: chunking, de-duplication by hash, reference counts, reads, writes and verification."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.operators.relational import beside, upsert
from granary.operators.storage import rows_before, saved


def chunk(files: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """key, blockno, data, length: block N holds [N * size, (N + 1) * size); empty content has no block.

    Characters of strings, bytes of binaries. The content is cut where it is scanned; nothing shuffles.
    """
    n = F.length(content)
    blocks = files.where(n > 0).select(F.col(key), F.col(content).alias("_c"), F.explode(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)).alias("blockno"))
    return blocks.select(key, F.col("blockno").cast("long").alias("blockno"), F.substring("_c", F.col("blockno") * size + 1, F.lit(size)).alias("data")).withColumn("length", F.length("data").cast("long"))


def with_hash(blocks: DataFrame, data: str = "data") -> DataFrame:
    """Blocks with `hash`, the SHA-256 of their data in hex."""
    return blocks.withColumn("hash", F.sha2(F.col(data).cast("binary"), 256))


def object_table(blocks: DataFrame) -> DataFrame:
    """hash, refcount, length of each distinct block; blocks without a hash (failed uploads) are no one's copies."""
    return blocks.where("hash is not null").groupBy("hash").agg(F.count("*").alias("refcount"), F.max("length").alias("length"))


def dedup_insert(objects: DataFrame, blocks: DataFrame) -> DataFrame:
    """Object table (hash, refcount, phys_size, length) after linking new blocks: hits count up, misses start at -1 bytes stored."""
    new = object_table(blocks)
    joined = objects.where("hash is not null").alias("o").join(new.alias("n"), "hash", "full")
    merged = joined.select("hash", (F.coalesce("o.refcount", F.lit(0)) + F.coalesce("n.refcount", F.lit(0))).alias("refcount"), F.coalesce("o.phys_size", F.lit(-1)).cast("long").alias("phys_size"), F.coalesce("o.length", "n.length").alias("length"))
    return merged.unionByName(objects.where("hash is null").select("hash", "refcount", "phys_size", "length"))


def dereference(objects: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects after dropping one reference per row of `removed` (hash), and the stored ones to delete.

    An object that was never uploaded (phys_size -1) has nothing to delete.
    """
    gone = removed.groupBy("hash").agg(F.count("*").alias("_n"))
    left = objects.join(gone, "hash", "left").withColumn("refcount", F.col("refcount") - F.coalesce("_n", F.lit(0))).drop("_n")
    return left.where("refcount > 0"), left.where("refcount <= 0 and phys_size >= 0").select("hash", "phys_size")


def mark_failed(objects: DataFrame, failed: DataFrame) -> DataFrame:
    """Objects with a null hash where the upload failed, so nothing links to them again."""
    bad = failed.select("id").distinct().withColumn("_failed", F.lit(True))
    return objects.join(bad, "id", "left").withColumn("hash", F.when(F.col("_failed").isNull(), F.col("hash"))).drop("_failed")


def read_range(blocks: DataFrame, files: DataFrame, key: str, block_size: int, offset: int, length: int) -> DataFrame:
    """key, data: bytes [offset, offset + length) of each file (key, size); missing blocks read as zeros, ends are clamped."""
    end = F.least(F.lit(offset + length), F.col("size"))
    wanted = files.where(F.col("size") > offset).select(key, "size", F.explode(F.sequence(F.lit(offset // block_size), F.greatest(F.lit(0), F.ceil(end / block_size) - 1).cast("int"))).alias("_b"))
    wanted = wanted.select(key, "size", F.col("_b").cast("long").alias("blockno"))
    have = wanted.join(blocks.select(key, "blockno", F.col("data").cast("binary").alias("data")), [key, "blockno"], "left")
    zeros = F.unhex(F.repeat(F.lit("00"), block_size))
    begin, stop = F.greatest(F.lit(offset) - F.col("blockno") * block_size, F.lit(0)), F.least(F.lit(offset + length), F.col("size")) - F.col("blockno") * block_size
    # a short block before a hole reads as zeros up to its end
    padded = F.substring(F.concat(F.coalesce("data", F.unhex(F.lit(""))), zeros), F.lit(1), F.lit(block_size))
    part = F.substring(padded, begin.cast("int") + 1, (F.least(stop, F.lit(block_size)) - begin).cast("int"))
    parts = have.select(key, "blockno", part.alias("p")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("blockno", "p"))).alias("s"))
    return parts.select(key, F.aggregate("s", F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["p"])).alias("data"))


def split_writes(writes: DataFrame, key: str, block_size: int) -> DataFrame:
    """key, blockno, at (offset inside the block), data, version of each write (key, offset, data, version), cut at block ends."""
    n = F.length("data")
    first, last = F.floor(F.col("offset") / block_size), F.floor((F.col("offset") + n - 1) / block_size)
    cut = writes.where(n > 0).withColumn("blockno", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("blockno") * block_size, F.col("offset"))
    stop = F.least((F.col("blockno") + 1) * block_size, F.col("offset") + n)
    return cut.select(key, "blockno", (begin - F.col("blockno") * block_size).alias("at"), F.substring("data", (begin - F.col("offset") + 1).cast("int"), (stop - begin).cast("int")).alias("data"), "version")


def apply_writes(blocks: DataFrame, writes: DataFrame, key: str, block_size: int) -> DataFrame:
    """Blocks (key, blockno, data binary) after writes in the order of `version`; later bytes win, gaps are zeros."""
    parts = split_writes(writes, key, block_size).withColumn("data", F.col("data").cast("binary"))
    grouped = parts.groupBy(key, "blockno").agg(F.sort_array(F.collect_list(F.struct("version", "at", "data"))).alias("w"))
    both = blocks.withColumn("data", F.col("data").cast("binary")).join(grouped, [key, "blockno"], "full")
    empty = F.unhex(F.lit(""))
    zeros = F.unhex(F.repeat(F.lit("00"), block_size))

    def put(acc: Column, w: Column) -> Column:
        head = F.substring(F.concat(acc, zeros), F.lit(1), w["at"].cast("int"))
        return F.concat(head, w["data"], F.substring(acc, (w["at"] + F.length(w["data"]) + 1).cast("int"), F.lit(block_size)))

    return both.select(key, "blockno", F.aggregate(F.coalesce("w", F.array().cast("array<struct<version:bigint,at:bigint,data:binary>>")), F.coalesce("data", empty), put).alias("data"))


def sizes_after_writes(files: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """key, size: the largest of a file's size and the ends of its writes."""
    ends = writes.groupBy(key).agg(F.max(F.col("offset") + F.length("data")).alias("_end"))
    return files.join(ends, key, "full").select(key, F.greatest(F.coalesce("size", F.lit(0)), F.coalesce("_end", F.lit(0))).cast("long").alias("size"))


def truncate(blocks: DataFrame, sizes: DataFrame, key: str, block_size: int) -> DataFrame:
    """Blocks after cutting files to their new size in `sizes` (key, size); files not listed stay as they are."""
    joined = blocks.join(sizes, key, "left")
    keep = F.col("size").isNull() | (F.col("blockno") * block_size < F.col("size"))
    cut = F.when(F.col("size").isNull(), F.col("data")).otherwise(F.substring("data", F.lit(1), F.least(F.lit(block_size), F.col("size") - F.col("blockno") * block_size).cast("int")))
    return joined.where(keep).select(key, "blockno", cut.alias("data"))


def remove_blocks(blocks: DataFrame, key: str, first: int, last: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Blocks without numbers from `first` up to but not including `last`, of all files or of those in `only` (key)."""
    inside = (F.col("blockno") >= first) & (F.lit(True) if last is None else F.col("blockno") < last)
    if only is not None:
        return blocks.join(only.select(key).distinct().withColumn("_only", F.lit(True)), key, "left").where(~(inside & F.col("_only").isNotNull())).select(*blocks.columns)
    return blocks.where(~inside)


def remove_range(blocks: DataFrame, objects: DataFrame, key: str, first: int, last: int | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks (key, blockno, hash) without a range, the objects after dropping its references, and the stored ones to delete."""
    rest = remove_blocks(blocks, key, first, last, only)
    gone = blocks.join(rest.select(key, "blockno"), [key, "blockno"], "left_anti").select("hash")
    return (rest, *dereference(objects, gone))


def verify_objects(objects: DataFrame, stored: DataFrame, key: str = "id", full: bool = True) -> DataFrame:
    """key, status: ok, missing, size or hash, of each object (key, length, hash hex) against stored (key, data).

    Null hashes abort, as the objects are known to be damaged. With full=False only presence counts.
    """
    if objects.where("hash is null").limit(1).count():
        raise ValueError("objects with null hashes: run the checker first")
    seen = stored.select(key, F.length("data").cast("long").alias("_n"), F.sha2(F.col("data").cast("binary"), 256).alias("_h")) if full else stored.select(key, F.lit(None).cast("long").alias("_n"), F.lit(None).cast("string").alias("_h"))
    joined = objects.join(seen.withColumn("_seen", F.lit(True)), key, "left")
    status = F.when(F.col("_seen").isNull(), "missing")
    if full:
        status = status.when(F.col("_n") != F.col("length"), "size").when(F.col("_h") != F.col("hash"), "hash")
    return joined.select(key, status.otherwise("ok").alias("status"))


def commit_cache(mapping: DataFrame, cached: DataFrame) -> DataFrame:
    """What a crash left in the cache (inode, blockno, hash) against the current mapping: keep, relink or add."""
    old = mapping.select("inode", "blockno", F.col("hash").alias("old_hash"))
    action = F.when(F.col("old_hash").isNull(), "add").when(F.col("old_hash") == F.col("hash"), "keep").otherwise("relink")
    return cached.join(old, ["inode", "blockno"], "left").select("inode", "blockno", "hash", "old_hash", action.alias("action"))


def apply_cache(mapping: DataFrame, objects: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After a crash: mapping (inode, blockno, hash), objects, and the stored objects to delete, with the cache committed.

    A cached block (inode, blockno, hash, length) equal to its mapping changes nothing; any other one is linked to the
    object of its hash, which is inserted if there is none (to be stored, phys_size -1), and its old object loses a reference.
    """
    actions = saved(commit_cache(mapping, cached.drop("length")).join(cached.select("inode", "blockno", "length"), ["inode", "blockno"]).where("action <> 'keep'"))
    linked = dedup_insert(objects, actions.select("hash", "length"))
    left, gone = dereference(linked, actions.where("action = 'relink'").select(F.col("old_hash").alias("hash")))
    return upsert(mapping.select("inode", "blockno", "hash"), actions.select("inode", "blockno", "hash"), ["inode", "blockno"]), left, gone


def verify_in_order(objects: DataFrame, skip: int = 0, key: str = "id") -> DataFrame:
    """Objects in the order of their keys without the first `skip`: where an interrupted verification goes on.

    Rows are dealt into ranges of keys. Ranges before the place to go on are left out whole, those after it kept whole,
    and only the range that holds it is numbered, so no task gets more than its range.
    """
    ranges = saved(objects.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    placed = ranges.join(F.broadcast(rows_before(ranges)), "_range")
    split = placed.where((F.col("_before") < skip) & (F.col("_before") + F.col("_rows") > skip))
    split = split.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(key))).where(F.col("_before") + F.col("_at") > skip)
    rest = placed.where(F.col("_before") >= skip).unionByName(split.drop("_at"))
    return rest.select(*objects.columns).orderBy(key)


def dedup_stats(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Files, block references, distinct objects, total and unique size, de-duplicated share in percent."""
    objects = object_table(blocks).agg(F.count("*").alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("unique_size"), F.coalesce(F.sum(F.col("length") * F.col("refcount")), F.lit(0)).alias("total_size"), F.coalesce(F.sum("refcount"), F.lit(0)).alias("blocks"))
    counted = files.agg(F.count("*").alias("files"))
    share = F.when(F.col("total_size") > 0, F.round(100.0 * F.col("unique_size") / F.col("total_size"), 4)).otherwise(0.0)
    return beside(counted, objects).select("files", "blocks", "objects", "total_size", "unique_size", share.alias("dedup_pct"))


def lru_cache(accesses: DataFrame, max_bytes: int, max_entries: int, partition: str = "cache") -> DataFrame:
    """hit and evicted of each access (cache, seq, key, bytes) under least-recent eviction, each cache for itself.

    What a cache holds depends on all accesses before, so a cache is one task's; its accesses are sorted on Spark and
    stream through in order of seq, then key, and only the bounded cache is held. The last used entry stays even where
    it alone is over `max_bytes`. A null cache is one of its own; null bytes count as 0.
    """
    names = [partition, "seq", "key", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, total = object(), OrderedDict(), 0
        for batch in batches:
            hits, evicted = [], []
            for cache, key, size in zip(*(batch.column(n).to_pylist() for n in (partition, "key", "bytes"))):
                if cache != current:
                    current, held, total = cache, OrderedDict(), 0
                hits.append(key in held)
                total += (size or 0) - held.pop(key, 0)
                held[key] = size or 0
                n = 0
                while len(held) > 1 and (total > max_bytes or len(held) > max_entries):
                    total -= held.popitem(last=False)[1]
                    n += 1
                evicted.append(n)
            columns = [*(batch.column(n) for n in names[:3]), pa.array(hits, pa.bool_()), pa.array(evicted, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names[:3], "hit", "evicted"])

    rows = accesses.select(partition, F.col("seq").cast("long").alias("seq"), "key", "bytes")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return rows.repartition(partition).sortWithinPartitions(partition, "seq", "key").mapInArrow(run, f"{kinds}, hit boolean, evicted long")
