"""The metadata model: seven tables, their keys and foreign keys, the two name views, and the seed rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "objects": "id long, hash binary, refcount long, phys_size long, length long",
    "inodes": "id long, uid long, gid long, mode long, mtime_ns long, atime_ns long, ctime_ns long, refcount long, size long, rdev long, locked boolean",
    "inode_blocks": "inode long, blockno long, obj_id long",
    "symlink_targets": "inode long, target binary",
    "names": "id long, name binary, refcount long",
    "contents": "rowid long, name_id long, inode long, parent_inode long",
    "ext_attributes": "inode long, name_id long, value binary",
}
PARAMS = "seq_no long, db_size long, metadata_block_size long, data_block_size long, revision int, label string, needs_fsck boolean, is_mounted boolean, inode_gen long, last_fsck double, last_modified double, db_sha256 string"
PRIMARY_KEYS = {"objects": ["id"], "inodes": ["id"], "inode_blocks": ["inode", "blockno"], "symlink_targets": ["inode"], "names": ["id"], "contents": ["rowid"], "ext_attributes": ["inode", "name_id"]}
UNIQUE_KEYS = {"objects": ["hash"], "names": ["name"], "contents": ["parent_inode", "name_id"]}
FOREIGN_KEYS = [
    ("inode_blocks", "inode", "inodes", "id"),
    ("inode_blocks", "obj_id", "objects", "id"),
    ("symlink_targets", "inode", "inodes", "id"),
    ("contents", "name_id", "names", "id"),
    ("contents", "inode", "inodes", "id"),
    ("contents", "parent_inode", "inodes", "id"),
    ("ext_attributes", "inode", "inodes", "id"),
    ("ext_attributes", "name_id", "names", "id"),
]

ROOT, CONTROL, LOST_FOUND = 1, 2, 3
# The POSIX file types and permission bits that modes are made of.
TYPE_MASK, DIRECTORY, REGULAR, SYMLINK, BLOCK_DEVICE, CHAR_DEVICE, FIFO, SOCKET = 0o170000, 0o040000, 0o100000, 0o120000, 0o060000, 0o020000, 0o010000, 0o140000


@dataclass(frozen=True)
class Tables:
    """One version of the metadata; every change gives a new one."""

    objects: DataFrame
    inodes: DataFrame
    inode_blocks: DataFrame
    symlink_targets: DataFrame
    names: DataFrame
    contents: DataFrame
    ext_attributes: DataFrame

    def with_(self, **changed: DataFrame) -> Tables:
        return replace(self, **changed)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in TABLES]

    def contents_v(self) -> DataFrame:
        """contents with the name itself."""
        return self.contents.join(self.names.select(F.col("id").alias("name_id"), "name"), "name_id").select("rowid", "name_id", "inode", "parent_inode", "name")

    def ext_attributes_v(self) -> DataFrame:
        return self.ext_attributes.join(self.names.select(F.col("id").alias("name_id"), "name"), "name_id").select("inode", "name_id", "value", "name")

    def register(self) -> None:
        """All tables and both views as temporary views for spark.sql."""
        for name, df in self.items():
            df.createOrReplaceTempView(name)
        self.contents_v().createOrReplaceTempView("contents_v")
        self.ext_attributes_v().createOrReplaceTempView("ext_attributes_v")


def create_tables(spark: SparkSession, rows: dict[str, list[tuple]] | None = None) -> Tables:
    """Tables of the given rows, empty where none are given."""
    return Tables(**{name: spark.createDataFrame((rows or {}).get(name, []), ddl) for name, ddl in TABLES.items()})


def init_tables(spark: SparkSession, now_ns: int = 0, uid: int = 0, gid: int = 0) -> Tables:
    """The seed rows: root directory, control inode and lost+found."""
    inode = lambda i, mode, refs: (i, uid, gid, mode, now_ns, now_ns, now_ns, refs, 0, 0, False)
    return create_tables(
        spark,
        {
            "inodes": [inode(ROOT, DIRECTORY | 0o755, 1), inode(CONTROL, REGULAR | 0o600, 42), inode(LOST_FOUND, DIRECTORY | 0o700, 1)],
            "names": [(1, b"lost+found", 1)],
            "contents": [(1, 1, LOST_FOUND, ROOT)],
        },
    )


def save_tables(tables: Tables, path: str) -> int:
    """Writes the tables as the next version and makes it the current one; the version's number.

    Tables go to a folder of their own. Only when all are there the pointer is replaced, by a rename that overwrites,
    which file systems do at once: readers see the old version or the new one, and a crash before leaves the old one.
    """
    spark = tables.inodes.sparkSession
    version = (current_version(spark, path) or 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{version:010d}/{name}")
    _point_to(spark, path, version)
    return version


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def _point_to(spark: SparkSession, path: str, version: int) -> None:
    fs, conf = _hadoop(spark)
    new, pointer = fs.Path(f"{path}/current.tmp"), fs.Path(f"{path}/current")
    files = new.getFileSystem(conf)
    out = files.create(new, True)
    out.writeBytes(str(version))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(new), files.makeQualified(pointer), overwrite)


def current_version(spark: SparkSession, path: str) -> int | None:
    """The version that the pointer names; None where nothing has been saved."""
    fs, conf = _hadoop(spark)
    pointer = fs.Path(f"{path}/current")
    if not pointer.getFileSystem(conf).exists(pointer):
        return None
    return int(spark.read.text(f"{path}/current").first()[0])


def load_tables(spark: SparkSession, path: str, version: int | None = None) -> Tables:
    """The current version, or an earlier one by its number; LookupError where there is none."""
    version = version or current_version(spark, path)
    if version is None:
        raise LookupError(f"no version in {path}")
    return Tables(**{name: spark.read.schema(ddl).parquet(f"{path}/v{version:010d}/{name}") for name, ddl in TABLES.items()})
