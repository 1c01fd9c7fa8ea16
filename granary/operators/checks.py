"""The consistency checker: one detector and one repair per rule, and a runner that applies them in their order.

A detector returns violations as a DataFrame (empty when all is well); a repair returns new tables. Later checks clean up
after earlier ones, so the order of CHECKS matters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalar import unique_names
from granary.operators.relational import dangling, delete_in, differences, recount
from granary.operators.storage import assign_ids, saved
from granary.operators.tree import reachable
from granary.plans.schema import CONTROL, DIRECTORY, FOREIGN_KEYS, LOST_FOUND, PRIMARY_KEYS, REGULAR, ROOT, SYMLINK, TYPE_MASK, UNIQUE_KEYS, BLOCK_DEVICE, CHAR_DEVICE, Tables

Detector = Callable[[Tables], DataFrame]
Repair = Callable[[Tables, DataFrame], Tables]


@dataclass(frozen=True)
class Check:
    name: str
    detect: Detector
    repair: Repair | None = None


def _kind(mode: str = "mode"):
    return F.col(mode).bitwiseAND(F.lit(TYPE_MASK))


# --- lost+found ---------------------------------------------------------------------------------------------


def lost_found(t: Tables) -> int | None:
    """The inode of /lost+found, if it is a directory."""
    row = t.contents_v().where((F.col("parent_inode") == ROOT) & (F.col("name") == F.lit(b"lost+found"))).join(t.inodes.withColumnRenamed("id", "inode"), "inode").where(_kind() == DIRECTORY).select("inode").head(1)
    return row[0].inode if row else None


def detect_lost_found(t: Tables) -> DataFrame:
    have = t.contents_v().where((F.col("parent_inode") == ROOT) & (F.col("inode") != ROOT) & (F.col("name") == F.lit(b"lost+found"))).join(t.inodes.withColumnRenamed("id", "inode"), "inode").where(_kind() == DIRECTORY)
    return t.inodes.sparkSession.range(1).select(F.lit("lost+found").alias("missing")).join(have.select(F.lit("lost+found").alias("missing")), "missing", "left_anti")


def repair_lost_found(t: Tables, _: DataFrame) -> Tables:
    spark = t.inodes.sparkSession
    wrong = t.contents_v().where((F.col("name") == F.lit(b"lost+found")) & ((F.col("parent_inode") == ROOT) | (F.col("parent_inode") == F.col("inode")))).select("rowid")
    contents = delete_in(t.contents, ["rowid"], wrong)
    old = t.inodes.where((F.col("id") == LOST_FOUND) & (_kind() == DIRECTORY)).head(1)
    inode = LOST_FOUND if old else t.inodes.agg(F.max("id")).first()[0] + 1
    if not old:
        t = t.with_(inodes=t.inodes.unionByName(spark.createDataFrame([(inode, 0, 0, DIRECTORY | 0o700, 0, 0, 0, 1, 0, 0, False)], t.inodes.schema)))
    return add_entries(t.with_(contents=contents), spark.createDataFrame([(inode, ROOT, b"lost+found")], "inode long, parent_inode long, name binary"))


def add_entries(t: Tables, entries: DataFrame) -> Tables:
    """contents and names after adding entries (inode, parent_inode, name); new names get new ids."""
    known = saved(t.names)
    new = entries.select("name").distinct().join(known.select("name"), "name", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    names = known.unionByName(assign_ids(new, ["name"], "id", top).withColumn("refcount", F.lit(0).cast("long")).select(*known.columns))
    rowid = t.contents.agg(F.coalesce(F.max("rowid"), F.lit(0))).first()[0]
    rows = assign_ids(entries.join(names.select(F.col("id").alias("name_id"), "name"), "name"), ["parent_inode", "name_id"], "rowid", rowid).select(*t.contents.columns)
    contents = t.contents.unionByName(rows)
    return t.with_(contents=contents, names=recount(names, "id", "refcount", [(contents, "name_id"), (t.ext_attributes, "name_id")]))


def move_to_lost_found(t: Tables, entries: DataFrame) -> Tables:
    """Entries (inode, name, optional rowid) under lost+found, with free names; rows with a rowid leave their old place."""
    home = lost_found(t)
    wanted = saved(entries.withColumn("parent_inode", F.lit(home).cast("long")))
    contents = delete_in(t.contents, ["rowid"], wanted) if "rowid" in entries.columns else t.contents
    free = unique_names(wanted, t.contents_v().where(F.col("parent_inode") == home).select("parent_inode", "name"), "parent_inode", "name", "inode")
    return add_entries(t.with_(contents=contents), free.select("inode", "parent_inode", F.col("new_name").cast("binary").alias("name")))


# --- reference counts ---------------------------------------------------------------------------------------


def _miscounted(df: DataFrame, references: list[tuple[DataFrame, str]]) -> DataFrame:
    right = recount(df, "id", "refcount", references).select("id", F.col("refcount").alias("counted"))
    return df.select("id", "refcount").join(right, "id").where(~F.col("refcount").eqNullSafe(F.col("counted")))


def detect_names_refcount(t: Tables) -> DataFrame:
    return _miscounted(t.names, [(t.contents, "name_id"), (t.ext_attributes, "name_id")])


def _set_counts(df: DataFrame, bad: DataFrame) -> DataFrame:
    return df.join(bad.select("id", "counted"), "id", "left").withColumn("refcount", F.coalesce("counted", "refcount")).select(*df.columns)


def repair_names_refcount(t: Tables, bad: DataFrame) -> Tables:
    return t.with_(names=_set_counts(t.names, bad))


def detect_objects_refcount(t: Tables) -> DataFrame:
    return _miscounted(t.objects, [(t.inode_blocks, "obj_id")]).unionByName(t.objects.where("refcount = 0").select("id", "refcount", F.lit(0).cast("long").alias("counted"))).distinct()


def repair_objects_refcount(t: Tables, bad: DataFrame) -> Tables:
    return t.with_(objects=_set_counts(t.objects, bad).where("refcount > 0"))


def detect_inodes_refcount(t: Tables) -> DataFrame:
    return _miscounted(t.inodes.where(~F.col("id").isin(ROOT, CONTROL)), [(t.contents, "inode")])


def repair_inodes_refcount(t: Tables, bad: DataFrame) -> Tables:
    bad = saved(bad)
    orphans = bad.where("counted = 0").select(F.col("id").alias("inode"), F.concat(F.lit("inode-"), F.col("id").cast("string")).cast("binary").alias("name"))
    t = move_to_lost_found(t, orphans)
    return t.with_(inodes=recount(t.inodes.where(~F.col("id").isin(ROOT, CONTROL)), "id", "refcount", [(t.contents, "inode")]).unionByName(t.inodes.where(F.col("id").isin(ROOT, CONTROL))))


# --- dangling references ------------------------------------------------------------------------------------


def detect_contents_name(t: Tables) -> DataFrame:
    return dangling(t.contents, "name_id", t.names, "id")


def repair_contents_name(t: Tables, bad: DataFrame) -> Tables:
    return move_to_lost_found(t, bad.select("rowid", "inode", F.concat(F.lit("entry-"), F.col("inode").cast("string")).cast("binary").alias("name")))


def detect_contents_inode(t: Tables) -> DataFrame:
    return dangling(t.contents, "inode", t.inodes, "id")


def repair_contents_inode(t: Tables, bad: DataFrame) -> Tables:
    contents = delete_in(t.contents, ["rowid"], bad)
    return t.with_(contents=contents, names=recount(t.names, "id", "refcount", [(contents, "name_id"), (t.ext_attributes, "name_id")]).where("refcount > 0"))


def detect_contents_parent(t: Tables) -> DataFrame:
    return dangling(t.contents, "parent_inode", t.inodes, "id")


def repair_contents_parent(t: Tables, bad: DataFrame) -> Tables:
    named = bad.join(t.names.select(F.col("id").alias("name_id"), "name"), "name_id")
    label = F.concat(F.lit("["), F.col("parent_inode").cast("string"), F.lit("]-"), F.make_valid_utf8(F.col("name").cast("string"))).cast("binary")
    return move_to_lost_found(t, named.select("rowid", "inode", label.alias("name")))


def detect_blocks_object(t: Tables) -> DataFrame:
    return dangling(t.inode_blocks, "obj_id", t.objects, "id")


def repair_blocks_object(t: Tables, bad: DataFrame) -> Tables:
    """Every directory entry of a damaged file goes to lost+found; the broken mapping goes."""
    bad = saved(bad)
    entries = t.contents_v().join(bad.select("inode").distinct(), "inode", "left_semi").where(F.col("parent_inode") != F.lit(lost_found(t)))
    t = move_to_lost_found(t, entries.select("rowid", "inode", "name"))
    return t.with_(inode_blocks=delete_in(t.inode_blocks, ["inode", "blockno"], bad))


def detect_blocks_inode(t: Tables) -> DataFrame:
    return dangling(t.inode_blocks, "inode", t.inodes, "id")


def repair_blocks_inode(t: Tables, bad: DataFrame) -> Tables:
    blocks = delete_in(t.inode_blocks, ["inode", "blockno"], bad)
    return t.with_(inode_blocks=blocks, objects=recount(t.objects, "id", "refcount", [(blocks, "obj_id")]).where("refcount > 0"))


def detect_attribute_name(t: Tables) -> DataFrame:
    return dangling(t.ext_attributes, "name_id", t.names, "id")


def repair_attribute_name(t: Tables, bad: DataFrame) -> Tables:
    """Attributes without a name are called lost+found_<n>, or what follows if that is taken."""
    label = F.concat(F.lit("lost+found_"), F.col("name_id").cast("string")).cast("binary")
    wanted = saved(bad.select(F.lit(0).alias("all"), F.col("name_id").alias("id"), label.alias("name")).distinct())
    free = unique_names(wanted, t.names.select(F.lit(0).alias("all"), "name"), "all")
    names = t.names.unionByName(free.select("id", F.col("new_name").cast("binary").alias("name"), F.lit(0).cast("long").alias("refcount")))
    return t.with_(names=recount(names, "id", "refcount", [(t.contents, "name_id"), (t.ext_attributes, "name_id")]))


def detect_attribute_inode(t: Tables) -> DataFrame:
    return dangling(t.ext_attributes, "inode", t.inodes, "id")


def repair_attribute_inode(t: Tables, bad: DataFrame) -> Tables:
    rest = delete_in(t.ext_attributes, ["inode", "name_id"], bad)
    return t.with_(ext_attributes=rest, names=recount(t.names, "id", "refcount", [(t.contents, "name_id"), (rest, "name_id")]).where("refcount > 0"))


def detect_symlink_inode(t: Tables) -> DataFrame:
    return dangling(t.symlink_targets, "inode", t.inodes, "id")


def repair_symlink_inode(t: Tables, bad: DataFrame) -> Tables:
    return t.with_(symlink_targets=delete_in(t.symlink_targets, ["inode"], bad))


# --- objects against what is stored -------------------------------------------------------------------------


def detect_null_hash(t: Tables) -> DataFrame:
    return t.objects.where("hash is null")


def repair_null_hash(t: Tables, _: DataFrame) -> Tables:
    return t.with_(objects=t.objects.where("hash is not null"))


def detect_stored(t: Tables, listing: DataFrame) -> DataFrame:
    """id, side (table or backend) of objects that only one side has; listing: id, length of each stored object."""
    return differences(t.objects.select("id"), listing.select("id"), ("table", "backend"))


def repair_stored(t: Tables, bad: DataFrame) -> Tables:
    return t.with_(objects=delete_in(t.objects, ["id"], bad.where("side = 'table'")))


def detect_pending_size(t: Tables, listing: DataFrame) -> DataFrame:
    return t.objects.where("phys_size = -1").join(listing.select("id", F.col("length").alias("stored")), "id").select("id", "stored")


def repair_pending_size(t: Tables, bad: DataFrame) -> Tables:
    return t.with_(objects=t.objects.join(bad, "id", "left").withColumn("phys_size", F.coalesce("stored", "phys_size")).select(*t.objects.columns))


def leftover_files(listing: DataFrame) -> DataFrame:
    """Names of unfinished uploads in a local store: those with a temporary suffix."""
    return listing.where(F.col("path").rlike(r"(\.tmp|#[0-9]+-[0-9]+\.tmp|\.[0-9a-f]+\.tmp)$"))


# --- sizes, loops, conventions ------------------------------------------------------------------------------


def detect_sizes(t: Tables, block_size: int) -> DataFrame:
    """id, size, min_size of inodes smaller than their last block's end; holes and slack are legal."""
    ends = t.inode_blocks.join(t.objects.select(F.col("id").alias("obj_id"), "length"), "obj_id").groupBy(F.col("inode").alias("id")).agg(F.max(F.col("blockno") * block_size + F.col("length")).alias("min_size"))
    return t.inodes.select("id", "size").join(ends, "id").where("size < min_size")


def repair_sizes(t: Tables, bad: DataFrame) -> Tables:
    return t.with_(inodes=t.inodes.join(bad.select("id", "min_size"), "id", "left").withColumn("size", F.coalesce("min_size", "size")).select(*t.inodes.columns))


def detect_loops(t: Tables) -> DataFrame:
    """node: directories that the root does not reach."""
    spark = t.inodes.sparkSession
    dirs = t.inodes.where(_kind() == DIRECTORY).select(F.col("id").alias("node"))
    edges = t.contents.where("parent_inode <> inode").select(F.col("parent_inode").alias("parent"), F.col("inode").alias("child"))
    edges = edges.join(dirs.withColumnRenamed("node", "child"), "child", "left_semi")
    return dirs.join(reachable(edges, spark.range(ROOT, ROOT + 1).select(F.col("id").alias("node"))).select("node"), "node", "left_anti")


def repair_loops(t: Tables, bad: DataFrame) -> Tables:
    """Anchors, in each round, every directory that is its own parent and the smallest of every other loop.

    The smallest that reaches a directory is found for all of them at once, by handing down minima along the entries. A
    directory that is its own smallest is anchored if it comes back to itself, or if nothing holds it.
    """
    while not (bad := saved(bad)).isEmpty():
        edges = saved(t.contents.join(bad.select(F.col("node").alias("inode")), "inode", "left_semi").join(bad.select(F.col("node").alias("parent_inode")), "parent_inode", "left_semi").select(F.col("parent_inode").alias("a"), F.col("inode").alias("b")))
        own = edges.where("a = b").select(F.col("a").alias("node"))
        low = saved(bad.select("node", F.col("node").alias("low")))
        while True:
            down = edges.join(low.select(F.col("node").alias("a"), F.col("low").alias("_l")), "a").select(F.col("b").alias("node"), F.col("_l").alias("low"))
            after = saved(low.unionByName(down).groupBy("node").agg(F.min("low").alias("low")))
            if after.join(low.withColumnRenamed("low", "_was"), "node").where("low < _was").isEmpty():
                break
            low = after
        above = edges.join(low.select(F.col("node").alias("a"), F.col("low").alias("_l")), "a")
        round_trip = above.where("_l = b").select(F.col("b").alias("node"))
        held = edges.select(F.col("b").alias("node")).distinct()
        least = low.where("node = low").select("node")
        victims = saved(own.unionByName(least.join(round_trip, "node", "left_semi")).unionByName(least.join(held, "node", "left_anti")).distinct())
        entries = t.contents_v().join(victims.select(F.col("node").alias("inode")), "inode").groupBy("inode").agg(F.min_by(F.struct("rowid", "name"), "rowid").alias("e")).select("e.rowid", "inode", "e.name")
        alone = victims.select(F.col("node").alias("inode")).join(t.contents, "inode", "left_anti").select(F.lit(-1).cast("long").alias("rowid"), "inode", F.concat(F.lit("inode-"), F.col("inode").cast("string")).cast("binary").alias("name"))
        t = move_to_lost_found(t, saved(entries.unionByName(alone)))
        t = t.with_(contents=saved(t.contents), names=saved(t.names))
        bad = detect_loops(t)
    return t


def detect_conventions(t: Tables) -> DataFrame:
    """id, rule for every broken UNIX convention; one pass over inodes and four key sets."""
    links = t.symlink_targets.select(F.col("inode").alias("id"), F.length("target").alias("target_length"))
    kids = t.contents.select(F.col("parent_inode").alias("id")).distinct().withColumn("has_children", F.lit(True))
    blocks = t.inode_blocks.select(F.col("inode").alias("id")).distinct().withColumn("has_blocks", F.lit(True))
    i = t.inodes.where(F.col("id") != CONTROL).join(links, "id", "left").join(kids, "id", "left").join(blocks, "id", "left").withColumn("kind", _kind())
    target, rules = F.col("target_length"), []
    rules.append(F.when(F.col("kind") == 0, "no type"))
    rules.append(F.when((F.col("kind") == SYMLINK) & target.isNull(), "symlink without target"))
    rules.append(F.when((F.col("kind") == SYMLINK) & target.isNotNull() & (F.col("size") != target), "symlink size"))
    rules.append(F.when((F.col("size") != 0) & ~F.col("kind").isin(0, REGULAR, SYMLINK, DIRECTORY), "size of special file"))
    rules.append(F.when((F.col("kind") != SYMLINK) & target.isNotNull(), "target of non-symlink"))
    rules.append(F.when((F.col("rdev") != 0) & ~F.col("kind").isin(BLOCK_DEVICE, CHAR_DEVICE), "device number"))
    rules.append(F.when(F.col("has_children") & ~F.col("kind").isin(0, DIRECTORY), "children of non-directory"))
    rules.append(F.when(F.col("has_blocks") & ~F.col("kind").isin(0, REGULAR), "blocks of non-file"))
    found = i.select("id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    return found.unionByName(t.names.where(F.length("name") > 255).select("id", F.lit("name too long").alias("rule")))


def repair_conventions(t: Tables, bad: DataFrame) -> Tables:
    """Only a missing type is mended: a directory if it has children, a file if not."""
    untyped = bad.where("rule = 'no type'").select("id", F.lit(True).alias("_u"))
    kids = t.contents.select(F.col("parent_inode").alias("id")).distinct().withColumn("_d", F.lit(True))
    mode = F.when(F.col("_u"), F.col("mode").bitwiseOR(F.when(F.col("_d"), DIRECTORY).otherwise(REGULAR))).otherwise(F.col("mode"))
    return t.with_(inodes=t.inodes.join(untyped, "id", "left").join(kids, "id", "left").withColumn("mode", mode.cast("long")).select(*t.inodes.columns))


def detect_foreign_keys(t: Tables) -> DataFrame:
    frames = dict(t.items())
    parts = [dangling(frames[a], c, frames[b], k).select(F.lit(a).alias("src_table"), F.lit(c).alias("src_column"), F.col(c).alias("value"), F.lit(b).alias("dst_table")) for a, c, b, k in FOREIGN_KEYS]
    return reduce(DataFrame.unionByName, parts)


def detect_duplicate_keys(t: Tables) -> DataFrame:
    """table, columns, copies of every primary or unique key that occurs more than once."""
    frames = dict(t.items())
    keys = [(a, k) for a, k in [*PRIMARY_KEYS.items(), *UNIQUE_KEYS.items()]]
    parts = []
    for name, columns in keys:
        df = frames[name].where(" and ".join(f"{c} is not null" for c in columns))
        parts.append(df.groupBy(*columns).agg(F.count("*").alias("copies")).where("copies > 1").select(F.lit(name).alias("table"), F.lit(",".join(columns)).alias("columns"), "copies"))
    return reduce(DataFrame.unionByName, parts)


def checks(block_size: int, listing: DataFrame | None = None) -> list[Check]:
    """All checks in their order; those against a store only with its listing (id, length)."""
    stored = [Check("objects stored", lambda t: detect_stored(t, listing), repair_stored), Check("pending sizes", lambda t: detect_pending_size(t, listing), repair_pending_size)] if listing is not None else []
    return [
        Check("lost+found", detect_lost_found, repair_lost_found),
        Check("names refcount", detect_names_refcount, repair_names_refcount),
        Check("contents name", detect_contents_name, repair_contents_name),
        Check("contents inode", detect_contents_inode, repair_contents_inode),
        Check("contents parent", detect_contents_parent, repair_contents_parent),
        Check("null hash", detect_null_hash, repair_null_hash),
        *stored,
        Check("blocks object", detect_blocks_object, repair_blocks_object),
        Check("blocks inode", detect_blocks_inode, repair_blocks_inode),
        Check("objects refcount", detect_objects_refcount, repair_objects_refcount),
        Check("inodes refcount", detect_inodes_refcount, repair_inodes_refcount),
        Check("sizes", lambda t: detect_sizes(t, block_size), repair_sizes),
        Check("attribute name", detect_attribute_name, repair_attribute_name),
        Check("attribute inode", detect_attribute_inode, repair_attribute_inode),
        Check("symlink inode", detect_symlink_inode, repair_symlink_inode),
        Check("loops", detect_loops, repair_loops),
        Check("conventions", detect_conventions, repair_conventions),
        Check("foreign keys", detect_foreign_keys),
        Check("duplicate keys", detect_duplicate_keys),
    ]


def run_checks(t: Tables, block_size: int, listing: DataFrame | None = None, repair: bool = True) -> tuple[Tables, dict[str, int]]:
    """Tables after all repairs, and the number of violations each check found.

    A repair's new tables are written, those it did not touch stay as they are. Without repairs all checks see the same
    tables, and one job counts what they find.
    """
    if not repair:
        counts = [check.detect(t).agg(F.count("*").alias("n")).select(F.lit(check.name).alias("name"), "n") for check in checks(block_size, listing)]
        n = dict(map(tuple, reduce(DataFrame.unionByName, counts).collect()))
        return t, {check.name: n[check.name] for check in checks(block_size, listing)}
    found = {}
    for check in checks(block_size, listing):
        bad = check.detect(t) if check.repair is None else saved(check.detect(t))
        found[check.name] = bad.count()
        if found[check.name] and check.repair:
            mended = check.repair(t, bad)
            t = Tables(**{name: df if df is getattr(t, name) else saved(df) for name, df in mended.items()})
    return t, found
