"""Object stores as tables: listings, reads, writes, deletions, and the small text files around them.

Spark's file sources list and read any Hadoop file system (local, s3a, gs, swift ...); the scheme of the path decides. Files
without a byte are not reported by them; store objects in their encoded form, or with a header, if they may be empty.
"""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalar import escape_key, parse_metadata_key, unescape_key

LISTING = "key string, length long, modificationTime timestamp"


def list_objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """key, length, modificationTime of stored objects by prefix, without their content; temporary names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    key = unescape_key(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.bin$", ""))
    return files.where(~F.element_at(F.split("path", "/"), -1).contains("#")).select(key.alias("key"), "length", "modificationTime").where(F.col("key").startswith(prefix))


def read_objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """key, data of stored objects by prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    key = unescape_key(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.bin$", ""))
    return files.select(key.alias("key"), F.col("content").alias("data")).where(F.col("key").startswith(prefix))


def file_system(path: str):
    """The pyarrow file system of a path, and the path inside of it: local, s3a, gs or hdfs; ValueError for others."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("s3" + path.removeprefix("s3a") if path.startswith("s3a://") else path)


def write_objects(objects: DataFrame, path: str) -> None:
    """Rows (key, data) as one file per object; the last writer wins.

    On file systems that can rename, an object is written under a temporary name first; object stores publish a whole
    object or none. The folder must be one that all executors share.
    """
    file_system(path)  # an unknown scheme raises here, before any task runs

    def put(rows) -> None:
        import uuid

        where, root = file_system(path)
        where.create_dir(root, recursive=True)
        for r in rows:
            name = f"{root}/{r.name}.bin"
            part = name if path.startswith(("s3", "gs")) else f"{name}#{uuid.uuid4().hex}.tmp"
            with where.open_output_stream(part) as f:
                f.write(r.data)
            if part != name:
                where.move(part, name)

    objects.select(escape_key(F.col("key")).alias("name"), F.col("data").cast("binary").alias("data")).foreachPartition(put)


def object_sizes(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """key, length of each asked key (key); null where the listing does not hold it."""
    return keys.select("key").distinct().join(listing.groupBy("key").agg(F.max("length").alias("length")), "key", "left")


def contains(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """key, found of each asked key."""
    return object_sizes(keys, listing).select("key", F.col("length").isNotNull().alias("found"))


def write_packed(objects: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows (key, data) as a Parquet table, which Hadoop's committer publishes at once on any file system."""
    objects.select("key", F.col("data").cast("binary").alias("data")).write.mode(mode).parquet(path)


def delete_objects(keys: DataFrame, path: str) -> DataFrame:
    """key, error of the objects that could not be deleted; deleting what is not there is no error."""
    file_system(path)  # an unknown scheme raises here

    def run(batches):
        import pandas as pd
        from pyarrow.fs import FileType

        where, root = file_system(path)
        for pdf in batches:
            out = []
            for key, name in zip(pdf["key"], pdf["name"]):
                try:
                    if where.get_file_info(f"{root}/{name}.bin").type != FileType.NotFound:
                        where.delete_file(f"{root}/{name}.bin")
                except FileNotFoundError:
                    pass
                except OSError as e:
                    out.append((key, str(e)))
            yield pd.DataFrame(out, columns=["key", "error"])

    return keys.select("key", escape_key(F.col("key")).alias("name")).mapInPandas(run, "key string, error string")


def metadata_versions(listing: DataFrame, prefix: str = "metadata_") -> DataFrame:
    """blockno, seq_no of versioned metadata blocks in a listing; other names, backups among them, are left out."""
    block, seq = parse_metadata_key(F.col("key"), prefix)
    return listing.select(block.alias("blockno"), seq.alias("seq_no")).where("blockno is not null")


def params_versions(listing: DataFrame, prefix: str = "params_") -> DataFrame:
    """seq_no of every stored params record."""
    return listing.where(F.col("key").rlike(f"^{prefix}[0-9a-f]+$")).select(F.conv(F.regexp_extract("key", f"^{prefix}([0-9a-f]+)$", 1), 16, 10).cast("long").alias("seq_no"))


def cached_blocks(listing: DataFrame) -> DataFrame:
    """inode, blockno, leftover of files in a cache folder named <inode>-<blockno>."""
    name = F.col("key")
    pattern = r"^(\d+)-(\d+)$"
    return listing.where(name.rlike(pattern) | name.endswith(".tmp")).select(F.expr(f"try_cast(nullif(regexp_extract(key, '{pattern.replace(chr(92), chr(92) * 2)}', 1), '') as long)").alias("inode"), F.expr(f"try_cast(nullif(regexp_extract(key, '{pattern.replace(chr(92), chr(92) * 2)}', 2), '') as long)").alias("blockno"), name.endswith(".tmp").alias("leftover"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """key of each line of a text file; blank lines are none."""
    return spark.read.text(path).select(F.trim("value").alias("key")).where("key <> ''")


def write_keys(keys: DataFrame, path: str) -> None:
    """One key a line; what is there already is not overwritten."""
    keys.select(F.col(keys.columns[0]).cast("string").alias("value")).write.mode("errorifexists").text(path)


def config_options(spark: SparkSession, text: str) -> DataFrame:
    """pattern, option, value, position of an INI configuration whose sections name a storage-url."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(text)
    rows = [(parser[s]["storage-url"], k, v, i) for i, s in enumerate(parser.sections()) if "storage-url" in parser[s] for k, v in parser[s].items() if k != "storage-url"]
    return spark.createDataFrame(rows, "pattern string, option string, value string, position int")


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
