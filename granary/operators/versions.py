"""Block-versioned snapshots: changes, as-of reconstruction, retention, state reconciliation, and backup ageing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.operators.storage import saved


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change (added, removed, changed) of blocks whose `hash` differs between two versions."""
    o, n = old.select(*keys, F.col("hash").alias("_o")), new.select(*keys, F.col("hash").alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed")
    return o.join(n, keys, "full").where(~F.col("_o").eqNullSafe(F.col("_n"))).select(*keys, change.alias("change"))


def incremental_snapshot(stored: DataFrame, current: DataFrame, seq_no: int) -> DataFrame:
    """Versioned blocks (blockno, seq_no, payload) with those of `current` (blockno, payload) that differ from the last stored one."""
    last = as_of_blocks(stored, F.lit(seq_no)).select("blockno", F.sha2("payload", 256).alias("_old"))
    changed = current.join(last, "blockno", "left").where(~F.sha2("payload", 256).eqNullSafe(F.col("_old")))
    return stored.unionByName(changed.select("blockno", F.lit(seq_no).cast("long").alias("seq_no"), "payload"))


def as_of_blocks(stored: DataFrame, seq_no: Column) -> DataFrame:
    """The version of each block with the greatest seq_no not after the target: one aggregation, no sort."""
    value = [c for c in stored.columns if c not in ("blockno", "seq_no")]
    newest = stored.where(F.col("seq_no") <= seq_no).groupBy("blockno").agg(F.max_by(F.struct("seq_no", *value), "seq_no").alias("v"))
    return newest.select("blockno", "v.*")


def restore(stored: DataFrame, params: DataFrame, seq_no: int) -> DataFrame:
    """blockno, payload of the database at a version: blocks past its size are left out, the last one is cut."""
    p = params.where(F.col("seq_no") == seq_no).select("db_size", "metadata_block_size", "db_sha256").first()
    if p is None:
        raise LookupError(f"no version {seq_no}")
    size = p.metadata_block_size
    inside = as_of_blocks(stored, F.lit(seq_no)).where(F.col("blockno") * size < p.db_size)
    return inside.select("blockno", F.substring("payload", F.lit(1), F.least(F.lit(size), F.lit(p.db_size) - F.col("blockno") * size).cast("int")).alias("payload"))


def restored_digest(blocks: DataFrame, block_size: int) -> DataFrame:
    """sha256 of restored blocks joined in order; the metadata image is one object of the reference's size limit."""
    joined = blocks.agg(F.sort_array(F.collect_list(F.struct("blockno", "payload"))).alias("s"))
    return joined.select(F.sha2(F.aggregate("s", F.unhex(F.lit("")), lambda a, x: F.concat(a, F.unhex(F.repeat(F.lit("00"), (x["blockno"] * block_size - F.length(a)).cast("int"))), x["payload"])), 256).alias("sha256"))


def restore_verified(stored: DataFrame, params: DataFrame, seq_no: int) -> DataFrame:
    """`restore`, or ValueError where the bytes do not have the recorded SHA-256."""
    p = params.where(F.col("seq_no") == seq_no).select("metadata_block_size", "db_sha256").first()
    blocks = restore(stored, params, seq_no)
    if restored_digest(blocks, p.metadata_block_size).first().sha256 != p.db_sha256:
        raise ValueError(f"version {seq_no} has another digest than recorded")
    return blocks


def restore_newest(stored: DataFrame, params: DataFrame, tries: int = 5) -> tuple[int, DataFrame]:
    """seq_no and blocks of the newest of the last `tries` versions whose bytes are as recorded; LookupError if none is."""
    for r in params.select("seq_no").distinct().orderBy(F.desc("seq_no")).limit(tries).collect():
        try:
            return r.seq_no, restore_verified(stored, params, r.seq_no)
        except ValueError:
            continue
    raise LookupError(f"none of the last {tries} versions can be restored")


def verify_versions(stored: DataFrame, params: DataFrame, last: int = 5) -> DataFrame:
    """seq_no, verified of the `last` newest versions; their numbers are few, their blocks stay distributed."""
    spark, out = params.sparkSession, []
    for r in params.select("seq_no").distinct().orderBy(F.desc("seq_no")).limit(last).collect():
        try:
            restore_verified(stored, params, r.seq_no)
            out.append((r.seq_no, True))
        except ValueError:
            out.append((r.seq_no, False))
    return spark.createDataFrame(out, "seq_no long, verified boolean")


def read_params(params: DataFrame, revision: int, min_seq: int | None = None):
    """The newest params record; ValueError if its revision is older or newer than ours, or if it is older than `min_seq`."""
    p = params.orderBy(F.desc("seq_no")).head(1)
    if not p:
        raise LookupError("no params")
    if p[0].revision < revision:
        raise ValueError(f"revision {p[0].revision} is too old, upgrade it first")
    if p[0].revision > revision:
        raise ValueError(f"revision {p[0].revision} is newer than {revision}")
    if min_seq is not None and p[0].seq_no < min_seq:
        raise ValueError(f"newest record is {p[0].seq_no}, expected {min_seq} at least")
    return p[0]


def retention(stored: DataFrame, params: DataFrame, keep: int, group: list[str] | None = None) -> DataFrame:
    """Versions (group, blockno, seq_no) that none of the `keep` newest snapshots needs.

    params: group, seq_no, n_blocks of each snapshot. A kept snapshot needs, for each of its blocks, the version with the
    greatest seq_no not after its own. In the order of versions this is one look ahead: a version of block b is needed
    by kept snapshots from its own seq_no up to before its block's next version, so no (snapshot, block) pairs are made.
    """
    group = group or []
    if group:
        newest = Window.partitionBy(*group).orderBy(F.desc("seq_no"))
        kept = params.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= keep)
    else:
        kept = params.orderBy(F.desc("seq_no")).limit(keep)
    kept = kept.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("seq_no", "n_blocks"))).alias("_kept"))  # `keep` entries
    ahead = Window.partitionBy(*group, "blockno").orderBy("seq_no")
    versions = stored.select(*group, "blockno", "seq_no").distinct().withColumn("_next", F.lead("seq_no").over(ahead))
    if group:
        joined = versions.join(kept, group, "left")
    else:
        few = kept.first()["_kept"]  # `keep` pairs of numbers
        joined = versions.withColumn("_kept", F.array(*[F.struct(F.lit(s).cast("long").alias("seq_no"), F.lit(n).cast("long").alias("n_blocks")) for s, n in few]))
    needed = F.exists(F.coalesce("_kept", F.array().cast("array<struct<seq_no:bigint,n_blocks:bigint>>")), lambda s: (s["seq_no"] >= F.col("seq_no")) & (F.col("_next").isNull() | (s["seq_no"] < F.col("_next"))) & (F.col("blockno") < s["n_blocks"]))
    return joined.where(~needed).select(*group, "blockno", "seq_no")


def reconcile(local: DataFrame, remote: DataFrame, now: float, month: float = 31 * 86400.0) -> DataFrame:
    """label, state: which side is newer, still mounted, unchecked, or due for a check (over 31 days)."""
    l = local.select("label", F.col("seq_no").alias("l_seq"))  # noqa: E741
    state = (
        F.when(F.col("l_seq").isNull(), "no local copy")
        .when(F.col("l_seq") < F.col("seq_no"), "local outdated")
        .when(F.col("l_seq") > F.col("seq_no"), "local newer")
        .when(F.col("is_mounted"), "mounted elsewhere")
        .when(F.col("needs_fsck"), "needs check")
        .when(F.lit(now) - F.col("last_fsck") > month, "check due")
        .otherwise("clean")
    )
    return remote.join(l, "label", "left").select("label", state.alias("state"))


def next_params(params: DataFrame, seq_no: int, now: float) -> DataFrame:
    """Params with a new version that restores `seq_no`: numbered after all, marked for a check."""
    last = params.agg(F.max("seq_no")).first()[0]
    new = params.where(F.col("seq_no") == seq_no).withColumn("seq_no", F.lit(max(int(now), last + 1)).cast("long")).withColumn("needs_fsck", F.lit(True)).withColumn("last_modified", F.lit(now))
    return params.unionByName(new)


def upgrade_params(old: DataFrame, renamed: dict[str, str], added: dict[str, Column], columns: list[str]) -> DataFrame:
    """Params of an earlier revision: keys renamed, new ones filled in, unknown ones dropped."""
    for a, b in renamed.items():
        old = old.withColumnRenamed(a, b)
    for c, value in added.items():
        if c not in old.columns:
            old = old.withColumn(c, value)
    return old.select(*columns)


def backup_ages(backups: DataFrame, partition: list[str], seconds: str, now: Column) -> DataFrame:
    """Step (smallest gap of a set), age at `now` and age in started cycles of each backup; none are ahead of `now`."""
    w = Window.partitionBy(*partition)
    gaps = backups.withColumn("_gap", F.col(seconds) - F.lag(seconds).over(w.orderBy(seconds)))
    full = gaps.withColumn("step", F.min("_gap").over(w)).withColumn("age", F.greatest(now - F.col(seconds), F.lit(0)))
    return full.withColumn("cycles", F.ceil(F.col("age") / F.col("step")).cast("long")).drop("_gap")


def backups_to_keep(names_and_ages: list[tuple[str, int]], cycles: list[int]) -> set[str]:
    """Backups that cover every age range now and as the set grows older, one new backup a cycle.

    Of several that fit, the first in the list covers a range.
    """
    ranges = list(zip([0, *cycles[:-1]], cycles))
    first_of: dict[int, str] = {}
    for name, age in names_and_ages:
        first_of.setdefault(age, name)
    place = {name: k for k, (name, _) in enumerate(names_and_ages)}
    ages = dict(names_and_ages)
    chosen: dict[str | int, int] = {}  # who covers a range, and at which step it had age 0
    for step in range(max(cycles)):
        if step:
            chosen[step] = step  # the backup made at that step
        for low, high in ranges:
            if any(low <= step - born < high for born in chosen.values()):
                continue
            fits = [first_of[age] for age in range(max(0, low - step), high - step) if age in first_of]
            if fits:
                name = min(fits, key=place.__getitem__)
                chosen[name] = -ages[name]
    return {name for name in chosen if isinstance(name, str)}


def next_state(state: DataFrame, present: DataFrame, partition: str = "backup_set") -> DataFrame:
    """partition, name, age of the backups present now, after a state (partition, name, age).

    Each new backup of a set makes the others one cycle older and is itself as old as there are newer ones after it;
    backups that are gone leave the state. Names sort by time.
    """
    old = state.join(present.select(partition, "name"), [partition, "name"], "left_semi")
    new = present.select(partition, "name").distinct().join(state.select(partition, "name"), [partition, "name"], "left_anti")
    ranked = new.withColumn("age", (F.row_number().over(Window.partitionBy(partition).orderBy(F.desc("name"))) - 1).cast("long"))
    more = new.groupBy(partition).agg(F.count("*").alias("_more"))
    aged = old.join(more, partition, "left").select(partition, "name", (F.col("age") + F.coalesce("_more", F.lit(0))).alias("age"))
    return aged.unionByName(ranked)


def expire_backups(backups: DataFrame, cycles: list[int], partition: str = "backup_set", most_deleted: float = 0.5) -> DataFrame:
    """partition, name, age, keep for every backup (partition, name, age).

    The greedy choice is sequential for a set. It looks at ages under max(cycles) only, and at one backup of each age, so
    its group is bounded by that number; older backups and the other ones of an age are joined back. Oldest first: by
    falling age, then name. A set that would lose more than `most_deleted` keeps all.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["age", "name"], ascending=[False, True])
        kept = backups_to_keep(list(zip(pdf["name"], pdf["age"].astype(int))), cycles)
        return pdf[pdf["name"].isin(kept)][[partition, "name"]]

    kind = backups.schema[partition].dataType.simpleString()
    asked = backups.where(F.col("age") < max(cycles)).groupBy(partition, "age").agg(F.min("name").alias("name"))
    kept = saved(asked.groupBy(partition).applyInPandas(run, f"{partition} {kind}, name string")).withColumn("_kept", F.lit(True))
    marked = saved(backups.select(partition, "name", "age").join(kept, [partition, "name"], "left").withColumn("_kept", F.coalesce("_kept", F.lit(False))))
    lost = marked.groupBy(partition).agg(F.avg(F.when(F.col("_kept"), 0.0).otherwise(1.0)).alias("_lost"))
    return marked.join(lost, partition).select(partition, "name", "age", (F.col("_kept") | (F.col("_lost") > most_deleted)).alias("keep"))
