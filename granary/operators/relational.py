"""Relational building blocks: version-producing DML, keyset pages, as-of and prefix joins, differences, running figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class NoRow(LookupError):
    """A query that must give a row gave none."""


class NotUnique(LookupError):
    """A query that must give one row gave more."""


def one_row(df: DataFrame):
    """The only row; NoRow or NotUnique otherwise. Reads two rows at most."""
    rows = df.limit(2).collect()
    if not rows:
        raise NoRow(str(df.columns))
    if len(rows) > 1:
        raise NotUnique(str(df.columns))
    return rows[0]


def one_value(df: DataFrame):
    return one_row(df)[0]


def value_or_none(df: DataFrame):
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise NotUnique(str(df.columns))
    return rows[0][0] if rows else None


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def typed(df: DataFrame, ddl: str) -> DataFrame:
    """`df` cast to a declared schema; an error if the number of columns differs."""
    want = df.sparkSession.createDataFrame([], ddl).schema
    if len(want) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(want)} declared")
    return df.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(df.columns, want)])


def query(spark: SparkSession, sql: str, *args) -> DataFrame:
    """A statement with ? parameters over the registered views."""
    return spark.sql(sql, args=list(args))


# --- DML: every change is a new version ---------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key `new` lacks. Keys in `new` are unique."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def last_wins(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return log.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def add_counts(old: DataFrame, delta: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Grouped upsert: `old`'s column plus the rows of `delta` per key; new keys start at their count."""
    n = delta.groupBy(*keys).agg(F.count("*").alias("_n"))
    return old.join(n, keys, "full").withColumn(column, F.coalesce(F.col(column), F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Columns changed where the condition holds; unknown counts as false."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])


def update_in(df: DataFrame, key: str, ids: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Columns changed where the key is among the first column of `ids`."""
    marked = df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("_in", F.lit(True)), key, "left")
    return update_where(marked, F.col("_in"), changes).drop("_in").select(*df.columns)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; unknown keeps the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def counted(df: DataFrame, condition: Column) -> tuple[DataFrame, Observation]:
    """`df` and how many of its rows meet a condition (`.get["affected"]` once it has run): the rows a change affects."""
    seen = Observation()
    return df.observe(seen, F.count_if(F.coalesce(condition, F.lit(False))).alias("affected")), seen


def write_back(df: DataFrame, dirty: DataFrame, key: str = "id") -> DataFrame:
    """`df` with the rows of `dirty` (same columns) in place of theirs; LookupError if one has no row, or more than one."""
    hits = dirty.select(key).join(df.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
    if not hits.where(~F.col("_n").eqNullSafe(1)).isEmpty():
        raise LookupError("a changed row must replace exactly one")
    return upsert(df, dirty.select(*df.columns), [key])


def delete_one(df: DataFrame, key: str, value) -> DataFrame:
    """`df` without the one row of a key; LookupError if there is none, or more than one."""
    if df.where(F.col(key) == F.lit(value)).limit(2).count() != 1:
        raise LookupError(value)
    return delete_where(df, F.col(key) == F.lit(value))


def compacted(df: DataFrame, files: int) -> DataFrame:
    """The same rows in `files` partitions, to be written again: many small files become few, without a shuffle."""
    return df.coalesce(files)


def delete_in(df: DataFrame, keys: list[str], ids: DataFrame) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), keys, "left_anti")


def recount(df: DataFrame, key: str, column: str, references: list[tuple[DataFrame, str]]) -> DataFrame:
    """`column` as the number of rows in all `references` (frame, key column) that name each key."""
    used = reduce(DataFrame.unionByName, [r.select(F.col(c).alias(key)) for r, c in references]).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return df.join(used, key, "left").withColumn(column, F.coalesce("_n", F.lit(0)).cast("long")).drop("_n").select(*df.columns)


def insert_select(df: DataFrame, key: str, id_map: DataFrame) -> DataFrame:
    """Rows copied for every (old, new) of `id_map`, under the new key."""
    copied = df.join(id_map, df[key] == id_map["old"]).withColumn(key, F.col("new")).select(*df.columns)
    return df.unionByName(copied)


# --- joins and set operations --------------------------------------------------------------------------------


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of `child` with a reference that `parent` lacks; null references are none."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").select(*child.columns)


def foreign_key_report(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """src_table, src_column, dst_table, violations of every declared key (table, column, parent, key)."""
    parts = [dangling(tables[t], c, tables[p], k).agg(F.count("*").alias("violations")).select(F.lit(t).alias("src_table"), F.lit(c).alias("src_column"), F.lit(p).alias("dst_table"), "violations") for t, c, p, k in keys]
    return reduce(DataFrame.unionByName, parts)


def differences(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Distinct rows that only one side has, with `side`."""
    return left.subtract(right).withColumn("side", F.lit(names[0])).unionByName(right.subtract(left).withColumn("side", F.lit(names[1])))


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows with a key above `after`, in its order: a top-k, no full sort."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def latest_n(df: DataFrame, partition: list[str], order: list[Column], n: int, skip: int = 0) -> DataFrame:
    """Rows `skip` + 1 to `skip` + n of each partition, newest first, with their rank."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where((F.col("rank") > skip) & (F.col("rank") <= skip + n))


def as_of(probe: DataFrame, history: DataFrame, by: str, time: str, value: Column, out: str) -> DataFrame:
    """Probe rows with the value of the latest history row of the same `by` not after their time.

    One union and one window per key instead of an inequality join: linear in both sides.
    """
    columns = probe.columns
    marked = probe.select(F.struct(*columns).alias("_p"), F.col(by).alias("_by"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_v"))
    past = history.select(F.lit(None).alias("_p"), F.col(by).alias("_by"), F.col(time).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"))
    w = Window.partitionBy("_by").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = past.unionByName(marked)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*[F.col(f"_p.{c}").alias(c) for c in columns], F.col("_v").alias(out))


def prefix_match(urls: DataFrame, patterns: DataFrame, order: str) -> DataFrame:
    """url, option, value: of all patterns (pattern, option, value) that start a url, the last in `order` wins.

    Patterns are expanded by their own length: an equality join on (length, prefix), no inequality join.
    """
    p = patterns.withColumn("_n", F.length("pattern"))
    lengths = [r[0] for r in p.select("_n").distinct().collect()]  # one number for each length in a configuration
    if not lengths:
        return p.select(F.col("pattern").alias("url"), "option", "value").limit(0)
    cut = urls.select("url").distinct().select("url", F.explode(F.array(*map(F.lit, lengths))).alias("_n")).where(F.length("url") >= F.col("_n")).withColumn("pattern", F.expr("substring(url, 1, _n)"))
    return cut.join(p, ["_n", "pattern"]).groupBy("url", "option").agg(F.max_by("value", order).alias("value"))


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row, without a join."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- ordered figures -----------------------------------------------------------------------------------------


def running_sum(df: DataFrame, partition: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """Sum of the rows before each one, as progress displays need it."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(column).over(w), F.lit(0)))


def sliding_rate(events: DataFrame, partition: list[str], seconds: Column, width: int) -> DataFrame:
    """Events of each second and the sum of the last `width` seconds' counts, per partition."""
    per_second = events.groupBy(*partition, seconds.alias("second")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*partition).orderBy("second").rangeBetween(-(width - 1), 0)
    return per_second.withColumn("in_window", F.sum("n").over(w)).withColumn("rate", F.col("in_window") / width)


def idle_commits(writes: DataFrame, key: list[str], seconds: Column, delay: float, horizon: float) -> DataFrame:
    """Last write of each run of writes to a key that was then idle for `delay` seconds, seen at `horizon`."""
    w = Window.partitionBy(*key).orderBy("_s", *[c for c in writes.columns if c.endswith("_id")])
    following = writes.withColumn("_s", seconds).withColumn("_next", F.lead("_s").over(w))
    return following.where(F.coalesce("_next", F.lit(horizon)) - F.col("_s") >= delay).withColumn("committed_at", F.col("_s") + delay).drop("_s", "_next")


def islands(numbers: DataFrame, partition: list[str], column: str) -> DataFrame:
    """Runs of consecutive numbers: first, last and size of each."""
    w = Window.partitionBy(*partition).orderBy(column)
    runs = numbers.select(*partition, column).distinct().withColumn("_run", F.col(column) - F.row_number().over(w))
    return runs.groupBy(*partition, "_run").agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count("*").alias("size")).drop("_run")
