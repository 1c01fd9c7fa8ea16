"""Keeping intermediate tables: Parquet in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, on a local master only, a fresh local folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="granary-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """`df` written once and read back: cuts the lineage of loops, and lost executors need not repeat it.

    The table is removed when the application ends.
    """
    path = f"{shared_folder(df.sparkSession)}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass


def rows_before(ranges: DataFrame) -> DataFrame:
    """_range, _rows (its rows) and _before (rows of the ranges before it) of rows dealt into numbered ranges."""
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_rows"))
    return sizes.withColumn("_before", F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows"))


def assign_ids(df: DataFrame, order: list[str], column: str = "id", after: int = 0) -> DataFrame:
    """Dense ids after `after` in the order of `order`, without sorting all rows in one task.

    Rows are dealt into ranges; ids are places inside a range plus the sizes of the ranges before it, one number a
    range. The high-water mark `after` is the caller's, so that ids are never reused.
    """
    ranges = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_at", inside).join(F.broadcast(rows_before(ranges).drop("_rows")), "_range").withColumn(column, (F.lit(after) + F.col("_before") + F.col("_at")).cast("long")).drop("_range", "_before", "_at")
