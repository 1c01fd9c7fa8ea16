"""Directory trees: reachability, paths, copying, locking, removal, and the single-entry operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.relational import recount, update_in
from granary.operators.storage import assign_ids, saved
from granary.plans.schema import CONTROL, DIRECTORY, ROOT, SYMLINK, TYPE_MASK, Tables


def reachable(edges: DataFrame, start: DataFrame, parent: str = "parent", child: str = "child", most: int = 10_000) -> DataFrame:
    """node, depth: all nodes that `start` (node) reaches, itself at depth 0. Cycles end, as nodes are visited once.

    One join per level with the frontier only; levels are written, so the plan stays small and survives lost executors.
    """
    frontier = saved(start.select(F.col(start.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for depth in range(1, most + 1):
        following = edges.join(frontier.select(F.col("node").alias(parent)), parent).select(F.col(child).alias("node")).where("node is not null").distinct()
        frontier = saved(following.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return visited
        visited = saved(visited.unionByName(frontier)) if depth % 20 == 0 else visited.unionByName(frontier)
    raise RuntimeError(f"deeper than {most}")


def unreachable(edges: DataFrame, nodes: DataFrame, root: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Nodes that the roots do not reach: loops and what hangs below them."""
    seen = reachable(edges, root, parent, child)
    return nodes.select(F.col(nodes.columns[0]).alias("node")).join(seen.select("node"), "node", "left_anti")


def paths(edges: DataFrame, root: DataFrame, parent: str = "parent", child: str = "child", name: str = "name", most: int = 10_000) -> DataFrame:
    """node, path (the root's is empty): of several ways to a node, the smallest of the shortest. RuntimeError above `most` levels."""
    level = saved(root.select(F.col(root.columns[0]).alias("node"), F.lit("").alias("path")))
    found = level
    for depth in range(1, most + 2):
        steps = edges.join(level.select(F.col("node").alias(parent), F.col("path").alias("_p")), parent)
        following = steps.groupBy(F.col(child).alias("node")).agg(F.min(F.concat("_p", F.lit("/"), F.col(name))).alias("path"))
        level = saved(following.join(found.select("node"), "node", "left_anti"))
        if level.isEmpty():
            return found
        found = saved(found.unionByName(level)) if depth % 20 == 0 else found.unionByName(level)
    raise RuntimeError(f"deeper than {most}")


def _with_saved(t: Tables, **changed: DataFrame) -> Tables:
    """`t` with some tables replaced, each written once, so that the plans of a series of operations do not grow."""
    return t.with_(**{name: saved(df) for name, df in changed.items()})


def _edges(t: Tables) -> DataFrame:
    return t.contents.where("parent_inode <> inode").select(F.col("parent_inode").alias("parent"), F.col("inode").alias("child"))


def subtree(t: Tables, root: int) -> DataFrame:
    """node: the inode `root` and all below it."""
    spark = t.inodes.sparkSession
    return reachable(_edges(t), spark.range(root, root + 1).select(F.col("id").alias("node"))).select("node")


def entry_of(t: Tables, parent: int, name: bytes):
    """The entry (rowid, name_id, inode) of a name in a directory; KeyError where it is missing."""
    name_row = t.names.where(F.col("name") == F.lit(name)).select("id").head(1)
    row = t.contents.where((F.col("parent_inode") == parent) & (F.col("name_id") == name_row[0].id)).select("rowid", "name_id", "inode").head(1) if name_row else []
    if not row:
        raise KeyError(name)
    return row[0]


def lookup(t: Tables, parent: int, name: bytes) -> int:
    """The inode of a name in a directory; `.` is the directory itself and `..` its parent (the root's is the root)."""
    if name == b".":
        return parent
    if name == b"..":
        above = t.contents.where(F.col("inode") == parent).orderBy("parent_inode").select("parent_inode").head(1)
        if not above and parent != ROOT:
            raise KeyError(name)
        return ROOT if parent == ROOT else above[0].parent_inode
    return entry_of(t, parent, name).inode


def inode_of(t: Tables, path: str) -> int:
    """Descends names from the root; KeyError where one is missing or the path is empty."""
    node = ROOT
    for part in path.lstrip("/").split("/"):
        node = lookup(t, node, part.encode())
    return node


def inodes_of(t: Tables, wanted: DataFrame) -> DataFrame:
    """path, inode (null where a name is missing) of many paths (path) at once: one join a level of the deepest path."""
    parts = saved(wanted.select("path").distinct().select("path", F.split(F.ltrim("path", F.lit("/")), "/").alias("_parts")))
    deepest = parts.agg(F.coalesce(F.max(F.size("_parts")), F.lit(0))).first()[0]
    names = t.contents_v().select("parent_inode", F.col("name").alias("_name"), F.col("inode").alias("_next"))
    now = parts.withColumn("inode", F.lit(ROOT).cast("long"))
    for k in range(deepest):
        asked = now.withColumn("_name", F.get("_parts", F.lit(k)).cast("binary")).withColumnRenamed("inode", "parent_inode")
        found = asked.join(names, ["parent_inode", "_name"], "left")
        now = saved(found.select("path", "_parts", F.when(F.col("_name").isNull(), F.col("parent_inode")).otherwise(F.col("_next")).alias("inode")))
    return now.select("path", "inode")


def read_link(t: Tables, inode: int) -> bytes:
    """The target of a symlink; KeyError if the inode is none."""
    row = t.symlink_targets.where(F.col("inode") == inode).select("target").head(1)
    if not row:
        raise KeyError(inode)
    return bytes(row[0].target)


def path_of(t: Tables, inode: int) -> str:
    """Ascends to the root by the smallest parent; ValueError above 255 levels."""
    parts: list[str] = []
    while inode != ROOT:
        row = t.contents_v().where(F.col("inode") == inode).orderBy("parent_inode", "name").head(1)
        if not row:
            raise KeyError(inode)
        parts.append(bytes(row[0].name).decode("utf-8", "replace"))
        inode = row[0].parent_inode
        if len(parts) > 255:
            raise ValueError("a loop, or too deep")
    return "".join("/" + p for p in reversed(parts))


def list_directory(t: Tables, inode: int, after: int = -1, size: int = 1000) -> DataFrame:
    """A page of a directory in the order of name ids."""
    return t.contents_v().where((F.col("parent_inode") == inode) & (F.col("name_id") > after)).orderBy("name_id").limit(size)


def recounted(t: Tables) -> Tables:
    """All reference counts as the tables say; names, objects and unlinked inodes without references go."""
    fixed = F.col("id").isin(ROOT, CONTROL)
    inodes = recount(t.inodes.where(~fixed), "id", "refcount", [(t.contents, "inode")]).where("refcount > 0").unionByName(t.inodes.where(fixed))
    alive = inodes.select("id")
    keep = lambda df: df.join(alive.withColumnRenamed("id", "inode"), "inode", "left_semi")
    blocks, links, xattrs = keep(t.inode_blocks), keep(t.symlink_targets), keep(t.ext_attributes)
    objects = recount(t.objects, "id", "refcount", [(blocks, "obj_id")]).where("refcount > 0")
    names = recount(t.names, "id", "refcount", [(t.contents, "name_id"), (xattrs, "name_id")]).where("refcount > 0")
    return t.with_(inodes=inodes, inode_blocks=blocks, symlink_targets=links, ext_attributes=xattrs, objects=objects, names=names)


def _recounted_and_saved(t: Tables, **changed: DataFrame) -> Tables:
    """The changed tables written first, then what the counts change."""
    t = recounted(_with_saved(t, **changed))
    return _with_saved(t, **{name: df for name, df in t.items() if name != "contents"})


def copy_subtree(t: Tables, source: int, target_parent: int, name_id: int) -> Tables:
    """A copy of the tree at `source` as entry `name_id` of `target_parent`.

    Hard links inside the tree stay shared; blocks are shared and counted; `locked` is not copied.
    """
    top = t.inodes.agg(F.max("id")).first()[0]
    rowid = t.contents.agg(F.coalesce(F.max("rowid"), F.lit(0))).first()[0]
    ids = saved(assign_ids(subtree(t, source).withColumnRenamed("node", "old"), ["old"], "new", top))
    moved = lambda df, key: df.join(ids, df[key] == ids["old"]).withColumn(key, F.col("new")).select(*df.columns)
    inodes = moved(t.inodes, "id").withColumn("locked", F.lit(False))
    inside = t.contents.join(ids.select(F.col("old").alias("parent_inode"), F.col("new").alias("_parent")), "parent_inode").join(ids.select(F.col("old").alias("inode"), F.col("new").alias("_inode")), "inode")
    entries = inside.select("name_id", F.col("_inode").alias("inode"), F.col("_parent").alias("parent_inode"))
    entry = ids.where(F.col("old") == source).select(F.lit(name_id).cast("long").alias("name_id"), F.col("new").alias("inode"), F.lit(target_parent).cast("long").alias("parent_inode"))
    contents = assign_ids(entries.unionByName(entry), ["parent_inode", "name_id"], "rowid", rowid).select(*t.contents.columns)
    return _recounted_and_saved(
        t,
        inodes=t.inodes.unionByName(inodes),
        contents=t.contents.unionByName(contents),
        inode_blocks=t.inode_blocks.unionByName(moved(t.inode_blocks, "inode")),
        symlink_targets=t.symlink_targets.unionByName(moved(t.symlink_targets, "inode")),
        ext_attributes=t.ext_attributes.unionByName(moved(t.ext_attributes, "inode")),
    )


def lock_subtree(t: Tables, root: int) -> Tables:
    return _with_saved(t, inodes=update_in(t.inodes, "id", subtree(t, root), {"locked": F.lit(True)}))


def _inode(t: Tables, inode: int):
    row = t.inodes.where(F.col("id") == inode).head(1)
    if not row:
        raise KeyError(inode)
    return row[0]


def _writable(t: Tables, inode: int):
    row = _inode(t, inode)
    if row.locked:
        raise PermissionError(inode)
    return row


def _is_directory(mode: int) -> bool:
    return mode & TYPE_MASK == DIRECTORY


def remove_subtree(t: Tables, parent: int, name: bytes) -> Tables:
    """Without an entry and all below it; PermissionError if the parent is locked. Locks below do not matter."""
    _writable(t, parent)
    entry = entry_of(t, parent, name)
    below = subtree(t, entry.inode).withColumnRenamed("node", "parent_inode")
    contents = t.contents.join(below, "parent_inode", "left_anti").where(F.col("rowid") != entry.rowid).select(*t.contents.columns)
    return _recounted_and_saved(t, contents=contents)


# Operations on one entry change the counts they touch and no others: no join with a whole table but for the blocks and
# attributes of an inode that goes.


def interned(t: Tables, name: bytes) -> tuple[Tables, int]:
    """`t` with a row for a name, and its id; a new one has no references yet."""
    row = t.names.where(F.col("name") == F.lit(name)).head(1)
    if row:
        return t, row[0].id
    new = t.names.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    return t.with_(names=t.names.unionByName(t.names.sparkSession.createDataFrame([(new, name, 0)], t.names.schema))), new


def _counted(df: DataFrame, key: int, by: int) -> DataFrame:
    return df.withColumn("refcount", F.when(F.col("id") == key, F.col("refcount") + by).otherwise(F.col("refcount")))


def _fewer(df: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """`df` (id, refcount) with as many references less as `uses` has rows of its id; rows without any go."""
    gone = uses.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("_gone"))
    left = df.join(gone, "id", "left").withColumn("refcount", F.col("refcount") - F.coalesce("_gone", F.lit(0)))
    return left.where("refcount > 0 or _gone is null").select(*df.columns)


def _released(t: Tables, inode: int) -> dict[str, DataFrame]:
    """The tables that change when an inode loses one entry: it goes with its last one."""
    if inode in (ROOT, CONTROL) or _inode(t, inode).refcount > 1:
        return {"inodes": _counted(t.inodes, inode, -1)}
    own, others = F.col("inode") == inode, F.col("inode") != inode
    out = {"inodes": t.inodes.where(F.col("id") != inode)}
    if not t.inode_blocks.where(own).isEmpty():
        out |= {"objects": _fewer(t.objects, t.inode_blocks.where(own), "obj_id"), "inode_blocks": t.inode_blocks.where(others)}
    if not t.symlink_targets.where(own).isEmpty():
        out["symlink_targets"] = t.symlink_targets.where(others)
    if not t.ext_attributes.where(own).isEmpty():
        out |= {"names": _fewer(t.names, t.ext_attributes.where(own), "name_id"), "ext_attributes": t.ext_attributes.where(others)}
    return out


def _removed(t: Tables, entry) -> Tables:
    changed = _released(t, entry.inode)
    names = _counted(changed.get("names", t.names), entry.name_id, -1).where((F.col("id") != entry.name_id) | (F.col("refcount") > 0))
    return _with_saved(t, **{**changed, "names": names, "contents": t.contents.where(F.col("rowid") != entry.rowid)})


def unlink(t: Tables, parent: int, name: bytes) -> Tables:
    """Without one entry that is no directory."""
    _writable(t, parent)
    entry = entry_of(t, parent, name)
    if _is_directory(_inode(t, entry.inode).mode):
        raise IsADirectoryError(name)
    return _removed(t, entry)


def remove_directory(t: Tables, parent: int, name: bytes) -> Tables:
    """Without one directory, which must be empty."""
    _writable(t, parent)
    entry = entry_of(t, parent, name)
    if not _is_directory(_inode(t, entry.inode).mode):
        raise NotADirectoryError(name)
    if not t.contents.where(F.col("parent_inode") == entry.inode).isEmpty():
        raise OSError(f"{name!r} is not empty")
    return _removed(t, entry)


def _added(t: Tables, inode: int, parent: int, name: bytes) -> dict[str, DataFrame]:
    """names and contents with one more entry."""
    t, name_id = interned(t, name)
    if not t.contents.where((F.col("parent_inode") == parent) & (F.col("name_id") == name_id)).isEmpty():
        raise FileExistsError(name)
    rowid = t.contents.agg(F.coalesce(F.max("rowid"), F.lit(0))).first()[0] + 1
    entry = t.contents.sparkSession.createDataFrame([(rowid, name_id, inode, parent)], t.contents.schema)
    return {"names": _counted(t.names, name_id, 1), "contents": t.contents.unionByName(entry)}


def link(t: Tables, inode: int, parent: int, name: bytes) -> Tables:
    """One more entry for an inode."""
    _writable(t, parent)
    return _with_saved(t, inodes=_counted(t.inodes, inode, 1), **_added(t, inode, parent, name))


def create(t: Tables, parent: int, name: bytes, mode: int, uid: int = 0, gid: int = 0, now_ns: int = 0, rdev: int = 0, target: bytes | None = None) -> Tables:
    """A new file, directory, device or (with `target`) symlink; a set-gid directory hands down its group."""
    above = _writable(t, parent)
    if above.mode & 0o2000:
        gid, mode = above.gid, mode | (0o2000 if _is_directory(mode) else 0)
    new = t.inodes.agg(F.max("id")).first()[0] + 1
    row = (new, uid, gid, mode, now_ns, now_ns, now_ns, 1, len(target or b""), rdev, False)
    spark = t.inodes.sparkSession
    changed = {"inodes": t.inodes.unionByName(spark.createDataFrame([row], t.inodes.schema)), **_added(t, new, parent, name)}
    if target is not None:
        if mode & TYPE_MASK != SYMLINK:
            raise ValueError("only a symlink has a target")
        changed["symlink_targets"] = t.symlink_targets.unionByName(spark.createDataFrame([(new, target)], t.symlink_targets.schema))
    return _with_saved(t, **changed)


def rename(t: Tables, old_parent: int, old: bytes, new_parent: int, new: bytes) -> Tables:
    """An entry under another name or parent; an entry of that name there goes first (directories must be empty)."""
    _writable(t, old_parent)
    _writable(t, new_parent)
    entry = entry_of(t, old_parent, old)
    try:
        there = entry_of(t, new_parent, new)
    except KeyError:
        there = None
    if there is not None:
        if there.rowid == entry.rowid:
            return t
        t = (remove_directory if _is_directory(_inode(t, there.inode).mode) else unlink)(t, new_parent, new)
    t, name_id = interned(t, new)
    here = F.col("rowid") == entry.rowid
    moved = t.contents.withColumn("name_id", F.when(here, F.lit(name_id)).otherwise(F.col("name_id"))).withColumn("parent_inode", F.when(here, F.lit(new_parent)).otherwise(F.col("parent_inode")))
    names = _counted(_counted(t.names, name_id, 1), entry.name_id, -1).where("refcount > 0")
    return _with_saved(t, contents=moved, names=names)


def reparent(contents: DataFrame, old_parent: int, new_parent: int) -> DataFrame:
    """All entries of one directory moved to another at once, which publishes a finished copy."""
    return contents.withColumn("parent_inode", F.when(F.col("parent_inode") == old_parent, F.lit(new_parent)).otherwise(F.col("parent_inode")))


def set_inode(t: Tables, inode: int, now_ns: int, **values: int) -> Tables:
    """Other mode bits, uid, gid, atime_ns, mtime_ns or rdev of one inode; the type stays and ctime becomes `now_ns`."""
    row = _writable(t, inode)
    if unknown := values.keys() - {"mode", "uid", "gid", "atime_ns", "mtime_ns", "rdev"}:
        raise ValueError(f"not settable: {sorted(unknown)}")
    if "mode" in values:
        values["mode"] = row.mode & TYPE_MASK | values["mode"] & ~TYPE_MASK
    here, values = F.col("id") == inode, {"ctime_ns": now_ns, **values}
    return _with_saved(t, inodes=t.inodes.withColumns({c: F.when(here, F.lit(v).cast("long")).otherwise(F.col(c)) for c, v in values.items()}))


def get_attribute(t: Tables, inode: int, name: bytes) -> bytes:
    """The value of an extended attribute; KeyError where it is missing."""
    row = t.ext_attributes_v().where((F.col("inode") == inode) & (F.col("name") == F.lit(name))).select("value").head(1)
    if not row:
        raise KeyError(name)
    return bytes(row[0].value)


def list_attributes(t: Tables, inode: int) -> DataFrame:
    """name of every extended attribute of an inode."""
    return t.ext_attributes_v().where(F.col("inode") == inode).select("name")


def set_attribute(t: Tables, inode: int, name: bytes, value: bytes) -> Tables:
    _writable(t, inode)
    t, name_id = interned(t, name)
    own = (F.col("inode") == inode) & (F.col("name_id") == name_id)
    new = t.ext_attributes.where(~own).unionByName(t.ext_attributes.sparkSession.createDataFrame([(inode, name_id, value)], t.ext_attributes.schema))
    changed = {"ext_attributes": new}
    if t.ext_attributes.where(own).isEmpty():
        changed["names"] = _counted(t.names, name_id, 1)
    return _with_saved(t, **changed)


def remove_attribute(t: Tables, inode: int, name: bytes) -> Tables:
    _writable(t, inode)
    get_attribute(t, inode, name)
    _, name_id = interned(t, name)
    rest = t.ext_attributes.where((F.col("inode") != inode) | (F.col("name_id") != name_id))
    return _with_saved(t, ext_attributes=rest, names=_counted(t.names, name_id, -1).where((F.col("id") != name_id) | (F.col("refcount") > 0)))
