"""Inject one fault, see its check find it, repair, and see a clean second run."""

import pytest
from pyspark.sql import functions as F

from granary.operators import checks, tree
from granary.plans.catalogue import _url_tables
from granary.plans.schema import DIRECTORY, LOST_FOUND, ROOT, create_tables, init_tables

SF = "/root/testdata/sf0.001"
BLOCK = 1024


def inode(i, mode=0o100644, refs=1, size=0, rdev=0):
    return (i, 0, 0, mode, 0, 0, 0, refs, size, rdev, False)


@pytest.fixture(scope="module")
def base(spark):
    rows = {
        "inodes": [inode(1, DIRECTORY), inode(2, 0o100600, 42), inode(3, DIRECTORY), inode(10, DIRECTORY), inode(11, size=1500), inode(12, 0o120777, 1, 4)],
        "names": [(1, b"lost+found", 1), (2, b"dir", 1), (3, b"file", 1), (4, b"link", 1), (5, b"user.x", 1)],
        "contents": [(1, 1, 3, 1), (2, 2, 10, 1), (3, 3, 11, 10), (4, 4, 12, 10)],
        "objects": [(1, b"\1" * 32, 1, 900, 1024), (2, b"\2" * 32, 1, 400, 476)],
        "inode_blocks": [(11, 0, 1), (11, 1, 2)],
        "symlink_targets": [(12, b"file")],
        "ext_attributes": [(11, 5, b"v")],
    }
    return create_tables(spark, rows)


def put(t, table, *rows):
    df = getattr(t, table)
    return t.with_(**{table: df.unionByName(df.sparkSession.createDataFrame(list(rows), df.schema))})


def change(t, table, where, **columns):
    df = getattr(t, table)
    for c, v in columns.items():
        df = df.withColumn(c, F.when(F.expr(where), F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType))
    return t.with_(**{table: df})


FAULTS = {
    "names refcount": lambda t: change(t, "names", "id = 3", refcount=7),
    "contents name": lambda t: put(t, "contents", (9, 99, 11, 1)),
    "contents inode": lambda t: put(put(t, "contents", (9, 6, 99, 1)), "names", (6, b"gone", 1)),
    "contents parent": lambda t: put(put(t, "contents", (9, 6, 11, 99)), "names", (6, b"lost", 1)),
    "null hash": lambda t: put(t, "objects", (3, None, 0, -1, 10)),
    "blocks object": lambda t: put(t, "inode_blocks", (11, 2, 99)),
    "blocks inode": lambda t: put(t, "inode_blocks", (99, 0, 1)),
    "objects refcount": lambda t: change(t, "objects", "id = 1", refcount=5),
    "inodes refcount": lambda t: put(t, "inodes", inode(20)),
    "sizes": lambda t: change(t, "inodes", "id = 11", size=1499),
    "attribute name": lambda t: put(t, "ext_attributes", (11, 88, b"w")),
    "attribute inode": lambda t: put(t, "ext_attributes", (99, 5, b"w")),
    "symlink inode": lambda t: put(t, "symlink_targets", (99, b"x")),
    "loops": lambda t: put(put(put(t, "inodes", inode(30, DIRECTORY), inode(31, DIRECTORY)), "contents", (30, 6, 31, 30), (31, 6, 30, 31)), "names", (6, b"loop", 2)),
    "conventions": lambda t: change(t, "inodes", "id = 11", mode=0o644),
    "lost+found": lambda t: t.with_(contents=t.contents.where("rowid <> 1"), names=t.names.where("id <> 1"), inodes=t.inodes.where("id <> 3")),
}


def test_clean(base):
    _, found = checks.run_checks(base, BLOCK, repair=False)
    assert not any(found.values()), found


@pytest.mark.parametrize("fault", FAULTS)
def test_fault_is_found_and_mended(base, fault):
    broken = FAULTS[fault](base)
    detect = {c.name: c for c in checks.checks(BLOCK)}[fault]
    assert detect.detect(broken).count() > 0
    mended = detect.repair(broken, detect.detect(broken))
    assert detect.detect(mended).count() == 0


def test_all_faults_at_once(base):
    broken = base
    for fault in ("names refcount", "contents parent", "blocks object", "inodes refcount", "sizes", "attribute inode"):
        broken = FAULTS[fault](broken)
    mended, found = checks.run_checks(broken, BLOCK)
    _, again = checks.run_checks(mended, BLOCK, repair=False)
    assert sum(n > 0 for n in found.values()) >= 5 and not any(again.values()), (found, again)


def test_store_checks(spark, base):
    listing = spark.createDataFrame([(1, 900), (5, 10)], "id long, length long")
    assert {(r.id, r.side) for r in checks.detect_stored(base, listing).collect()} == {(2, "table"), (5, "backend")}
    pending = change(base, "objects", "id = 1", phys_size=-1)
    bad = checks.detect_pending_size(pending, listing)
    assert checks.repair_pending_size(pending, bad).objects.where("id = 1").first().phys_size == 900


@pytest.mark.parametrize(("blocks", "size", "bad"), [([0], 341, False), ([0], 340, True), ([1], 1365, False), ([0, 1], 1365, False), ([0, 1], 1364, True), ([0, 1], 1366, False), ([0, 1], 1024, True)])
def test_smallest_size(spark, blocks, size, bad):
    t = create_tables(spark, {"inodes": [inode(5, size=size)], "objects": [(1, b"x", len(blocks), 1, 341)], "inode_blocks": [(5, b, 1) for b in blocks]})
    assert (checks.detect_sizes(t, 1024).count() > 0) == bad


def test_tree_operations_leave_consistent_tables(spark):
    t = init_tables(spark)
    t = tree.create(t, ROOT, b"d", DIRECTORY | 0o755)
    d = tree.inode_of(t, "/d")
    t = tree.create(t, d, b"f", 0o100644)
    f = tree.inode_of(t, "/d/f")
    t = tree.link(t, f, ROOT, b"g")
    t = tree.create(t, d, b"s", 0o120777, target=b"f")
    t = tree.set_attribute(t, f, b"user.a", b"1")
    assert tree.path_of(t, f) in ("/g", "/d/f") and t.inodes.where(F.col("id") == f).first().refcount == 2
    name_id = t.names.where(F.col("name") == F.lit(b"d")).first().id
    t = tree.copy_subtree(t, d, LOST_FOUND, name_id)
    assert tree.inode_of(t, "/lost+found/d/f") != f
    t = tree.rename(t, ROOT, b"g", d, b"h")
    with pytest.raises(KeyError):
        tree.inode_of(t, "/g")
    with pytest.raises(OSError):
        tree.unlink(t, ROOT, b"d")
    t = tree.unlink(t, d, b"h")
    locked = tree.lock_subtree(t, d)
    with pytest.raises(PermissionError):
        tree.unlink(locked, d, b"f")
    _, found = checks.run_checks(t, BLOCK, repair=False)
    assert not any(found.values()), found
    t = tree.remove_subtree(t, ROOT, b"d")
    assert {tree.path_of(t, r.id) for r in t.inodes.where("id > 3").collect()} == {"/lost+found/d", "/lost+found/d/f", "/lost+found/d/s"}


def test_catalogue_tables_are_clean_after_repair(spark):
    t = _url_tables(spark, SF)
    assert checks.detect_lost_found(t).count() == 1


def test_repairs_write_only_what_they_change(spark, monkeypatch):
    t = init_tables(spark)
    t = t.with_(names=t.names.withColumn("refcount", F.lit(7).cast("long")))
    written = []
    monkeypatch.setattr(checks, "saved", lambda df, plain=checks.saved: written.append(df) or plain(df))
    mended, found = checks.run_checks(t, 1024)
    assert {k: n for k, n in found.items() if n} == {"names refcount": 1}
    assert [name for name, df in mended.items() if df is not getattr(t, name)] == ["names"]
    written.clear()
    assert set(checks.run_checks(mended, 1024, repair=False)[1].values()) == {0} and not written
