"""Helpers that the text operators share: tables in the shared folder, Arrow batches, links to components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="granary-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass


def drop_written(df: DataFrame) -> None:
    """Removes a table of `written` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows (one more than rows). Null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column` (a longer row comes alone): memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal integer `keys` out of batches sorted by them, one table each; groups may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if i or first != last:
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the public-domain murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def blob_rows(rows: np.ndarray) -> pa.Array:
    """A 2-d array as one binary value per row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else rows.itemsize
    at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, at.buffers()[1], pa.py_buffer(rows.tobytes())])


def _with_least(edges: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """`edges` (a, b) with the smallest `b` of their `a` as `m`, and a, m of every vertex.

    Vertices of over `hub` edges are few (edges / hub at most) and are broadcast; their edges stay where they are.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    marked = edges.join(F.broadcast(low.where(F.col("n") > hub).select("a", F.col("m").alias("hub_m"))), "a", "left")
    hubs = marked.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m"))
    rest = marked.where("hub_m is null").select("a", "b").join(low.select("a", "m"), "a")
    return hubs.unionByName(rest), low.select("a", "m")


def _with_roots(now: DataFrame) -> DataFrame:
    """v, root of stars (a, b), the roots included."""
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges (a, b) but the smallest of its component, and that smallest one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(x := x[(differ := label[x] != label[y])]):
        y = y[differ]
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while not np.array_equal(label, label[label]):
            label = label[label]
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def _contract(block: int):
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stars of each `block` edges of a task."""
        held, n = [], 0

        def done() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                held.append((part.column("a").to_numpy(), part.column("b").to_numpy()))
                n += part.num_rows
                if n >= block:
                    yield done()
                    held, n = [], 0
        if held:
            yield done()

    return contract


def components(edges: DataFrame, most_rounds: int = 1000, hubs: int = 1000, block: int = 0) -> DataFrame:
    """Vertex `v` and smallest reachable vertex `root` for every end of `edges` (a, b: long).

    With a `block`, edges are first contracted to stars, `block` of them at a time, without a shuffle; where `block`
    edges or fewer are left, these are contracted once more and there are no rounds. The edges are written before that:
    they come from Python steps, and a second one in the same stage doubles the Python workers of an executor, which
    keep their memory for later stages. Rounds alternate large-star and small-star steps: each is one aggregation with map-side combining and one join on the vertex. A vertex with over
    1 / `hubs` of all edges (2 * `hubs` at most) is joined by broadcast, so that no task has more edges of one vertex
    than that share or 1000. Rounds are written to the shared folder; they end when a round changes nothing;
    RuntimeError if `most_rounds` were not enough.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(pairs if block else pairs.distinct())
    mark, count = None, now.count()
    if count > block > 0:
        contracted = written(now.mapInArrow(_contract(block), "a long, b long"))
        drop_written(now)
        now, count = contracted, contracted.count()
    if count <= block:
        settled = written(now.coalesce(1).mapInArrow(_contract(2 * block), "a long, b long"))
        drop_written(now)
        return _with_roots(settled)
    for _ in range(most_rounds):
        hub = max(1000, count // hubs)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined, _ = _with_least(both, hub)
        large = joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        joined, low = _with_least(large, hub)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        drop_written(now)
        now = after
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("coalesce(max(a), -1)")).first()
        if seen == mark:
            break
        mark, count = seen, seen[0]
    else:
        raise RuntimeError(f"unfinished after {most_rounds} rounds")
    return _with_roots(now)
