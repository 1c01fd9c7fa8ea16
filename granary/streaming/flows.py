"""Continuous computations: idle commits, rates, log throttling, and micro-batch sinks, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, time: str = "ts", files_per_trigger: int = 1) -> DataFrame:
    """A Parquet file or folder of such files as a stream, its time column with a zone, as watermarks need it."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a file or a folder; a plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern).withColumn(time, F.col(time).cast("timestamp"))


def idle_sessions(events: DataFrame, keys: list[str], time: str, gap: str, watermark: str) -> DataFrame:
    """Runs of writes to a key that end when none follows for `gap`: what an idle-timeout commit flushes."""
    window = F.session_window(time, gap)
    return events.withWatermark(time, watermark).groupBy(*keys, window).agg(F.count("*").alias("writes"), F.max(time).alias("last_write")).select(*keys, "last_write", F.col("session_window.end").alias("committed_at"), "writes")


def rates(events: DataFrame, time: str, width: str, step: str, watermark: str) -> DataFrame:
    """Events in each sliding window."""
    return events.withWatermark(time, watermark).groupBy(F.window(time, width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], time: str, watermark: str) -> DataFrame:
    """The first event of each content, forgotten after the watermark."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def throttle(events: DataFrame, key: str, seconds: Column, limit: float, order: str) -> DataFrame:
    """Events of a stream that pass: for each key one per `limit` seconds, counted from the last that passed."""
    columns = [*events.columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["_s", order])
        keep = []
        for s in rows["_s"]:
            keep.append(last is None or s - last >= limit)
            last = s if keep[-1] else last
        state.update((last,))
        yield rows[keep][columns]

    return events.withColumn("_s", seconds.cast("double")).groupBy(key).applyInPandasWithState(run, kinds, "last double", "append", GroupStateTimeout.NoTimeout)


def throttle_batch(events: DataFrame, key: str, seconds: Column, limit: float, order: str, always: Column | None = None) -> DataFrame:
    """The same for a finished table; a key's events stream through one pass in order, holding one number.

    Events for which `always` is true (the last of a series) pass in any case, and the next ones count from them.
    """
    columns = [*events.columns]
    marked = events.withColumn("_s", seconds.cast("double")).withColumn("_always", F.coalesce(always, F.lit(False)) if always is not None else F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for pdf in batches:
            keep = []
            for k, s, exempt in zip(pdf[key], pdf["_s"], pdf["_always"]):
                if k != current:
                    current, last = k, None
                keep.append(bool(exempt) or last is None or s - last >= limit)
                last = s if keep[-1] else last
            yield pdf[keep][columns]

    return marked.repartition(key).sortWithinPartitions(key, "_s", order).mapInPandas(run, events.schema)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Hands micro-batches to `each`; with an interval for good, without one until what is there is done."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's finished rows as Parquet until what is there is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
