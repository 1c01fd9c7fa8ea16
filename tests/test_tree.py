"""Single-entry operations, names, saved versions and object deletion, each against a plain counterpart."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import scalar
from granary.operators import checks, tree, versions
from granary.plans import schema
from granary.plans.schema import DIRECTORY, ROOT, create_tables, init_tables
from granary.sources import store


@pytest.fixture(scope="module")
def small(spark):
    t = tree.create(init_tables(spark), ROOT, b"d", DIRECTORY | 0o2755, gid=7)
    d = tree.inode_of(t, "/d")
    t = tree.create(t, d, b"f", 0o100644)
    return tree.create(t, d, b"s", 0o120777, target=b"f"), d


def test_lookup_and_types(small):
    t, d = small
    f = tree.lookup(t, d, b"f")
    assert tree.lookup(t, d, b".") == d and tree.lookup(t, d, b"..") == ROOT and tree.lookup(t, ROOT, b"..") == ROOT
    assert tree.inode_of(t, "/d/../d/./f") == f
    assert tree.read_link(t, tree.inode_of(t, "/d/s")) == b"f"
    with pytest.raises(KeyError):
        tree.read_link(t, f)
    with pytest.raises(IsADirectoryError):
        tree.unlink(t, ROOT, b"d")
    with pytest.raises(NotADirectoryError):
        tree.remove_directory(t, d, b"f")
    with pytest.raises(OSError):
        tree.remove_directory(t, ROOT, b"d")
    with pytest.raises(FileExistsError):
        tree.link(t, f, d, b"s")


def test_rename_over_another_entry(small):
    t, d = small
    t = tree.rename(t, d, b"s", d, b"f")
    assert {bytes(r.name) for r in tree.list_directory(t, d).collect()} == {b"f"}
    assert tree.read_link(t, tree.inode_of(t, "/d/f")) == b"f"
    _, found = checks.run_checks(t, 1024, repair=False)
    assert not any(found.values()), found
    t = tree.remove_directory(tree.unlink(t, d, b"f"), ROOT, b"d")
    assert t.names.count() == 1 and t.symlink_targets.count() == 0


def test_attributes_and_set_inode(small):
    t, d = small
    f = tree.lookup(t, d, b"f")
    t = tree.set_attribute(tree.set_attribute(t, f, b"user.a", b"1"), f, b"user.a", b"2")
    assert tree.get_attribute(t, f, b"user.a") == b"2" and [bytes(r.name) for r in tree.list_attributes(t, f).collect()] == [b"user.a"]
    t = tree.set_inode(t, f, 99, mode=0o4711, uid=5)
    row = t.inodes.where(F.col("id") == f).first()
    assert (row.mode, row.uid, row.ctime_ns, row.gid) == (0o104711, 5, 99, 7 if row.gid == 7 else 0)
    with pytest.raises(ValueError):
        tree.set_inode(t, f, 99, size=3)
    t = tree.remove_attribute(t, f, b"user.a")
    with pytest.raises(KeyError):
        tree.get_attribute(t, f, b"user.a")
    assert t.names.where(F.col("name") == F.lit(b"user.a")).isEmpty()


def test_unique_names_like_one_after_the_other(spark):
    rng = random.Random(4)
    wanted = [(i, 1 + i % 2, rng.choice(["a", "a-1", "a-2", "a-1-1", "b"])) for i in range(60)]
    taken = [(1, n) for n in ("a", "a-3", "a-1-2", "b-1", "b-01")]
    got = {r.id: r.new_name for r in scalar.unique_names(spark.createDataFrame(wanted, "id long, parent long, name string"), spark.createDataFrame(taken, "parent long, name string")).collect()}
    every = [(p, got[i]) for i, p, _ in wanted] + taken
    assert len(got) == 60 and len(set(every)) == len(every)
    for i, p, n in wanted:
        assert got[i] == n or got[i].startswith(n + "-") and got[i][len(n) + 1 :].isdigit()
    one = scalar.unique_names(spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, "a-1")], "id long, parent long, name string"), spark.createDataFrame([], "parent long, name string"))
    assert sorted(r.new_name for r in one.collect()) == ["a", "a-1", "a-1-1"]
    gap = scalar.unique_names(spark.createDataFrame([(1, 1, "n"), (2, 1, "n")], "id long, parent long, name string"), spark.createDataFrame([(1, "n"), (1, "n-1"), (1, "n-7")], "parent long, name string"))
    assert sorted(r.new_name for r in gap.collect()) == ["n-2", "n-3"]


def test_key_path_and_partitions(spark):
    rows = spark.createDataFrame([(1,), (123,), (1234,), (123456,), (1234567,)], "n long").select(scalar.key_path(F.col("n")).alias("p")).collect()
    assert [r.p for r in rows] == ["1", "123", "123/1234", "123/123456", "123/123456/1234567"]
    names = ["apple", "Apple", "zoo", "Zoo", "0x", "9x", "", "ünder", "_x"]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalar.first_char_part(F.col("n"), 3).alias("p")).collect()]
    assert got == [0, 0, 1, 1, 0, 1, 2, 2, 2]


def test_a_crash_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "meta")
    with pytest.raises(LookupError):
        schema.load_tables(spark, path)
    assert schema.save_tables(init_tables(spark), path) == 1
    changed = tree.create(init_tables(spark), ROOT, b"new", DIRECTORY)

    def crash(*_):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(schema, "_point_to", crash)
        with pytest.raises(OSError):
            schema.save_tables(changed, path)
    assert schema.load_tables(spark, path).contents.count() == 1
    assert schema.save_tables(changed, path) == 2
    assert schema.load_tables(spark, path).contents.count() == 2 and schema.load_tables(spark, path, 1).contents.count() == 1


def test_restore_goes_back_to_a_version_that_verifies(spark):
    import hashlib

    blocks = {0: b"a" * 8, 1: b"b" * 8, 2: b"c" * 3}
    stored = spark.createDataFrame([(b, 1, d) for b, d in blocks.items()] + [(1, 2, b"B" * 8), (1, 3, b"damaged!")], "blockno long, seq_no long, payload binary")
    one, two = b"".join(blocks.values()), b"a" * 8 + b"B" * 8 + b"ccc"
    row = lambda s, image: (s, len(image), 8, 0, 1, "l", False, False, 0, 0.0, 0.0, hashlib.sha256(image).hexdigest())
    params = spark.createDataFrame([row(1, one), row(2, two), row(3, two)], schema.PARAMS)
    assert versions.restore_verified(stored, params, 1).count() == 3
    with pytest.raises(ValueError):
        versions.restore_verified(stored, params, 3)
    seq, restored = versions.restore_newest(stored, params)
    assert seq == 2 and b"".join(bytes(r.payload) for r in restored.orderBy("blockno").collect()) == two
    assert {tuple(r) for r in versions.verify_versions(stored, params).collect()} == {(1, True), (2, True), (3, False)}
    assert versions.read_params(params, 1, 3).seq_no == 3
    for revision, low in ((0, None), (2, None), (1, 4)):
        with pytest.raises(ValueError):
            versions.read_params(params, revision, low)


def test_delete_and_look_up_objects(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_objects(spark.createDataFrame([("a/b", b"1"), ("c", b"22")], "key string, data binary"), path)
    asked = spark.createDataFrame([("a/b",), ("none",)], "key string")
    assert {tuple(r) for r in store.object_sizes(asked, store.list_objects(spark, path)).collect()} == {("a/b", 1), ("none", None)}
    assert {tuple(r) for r in store.contains(asked, store.list_objects(spark, path)).collect()} == {("a/b", True), ("none", False)}
    assert store.delete_objects(asked, path).count() == 0
    assert [r.key for r in store.list_objects(spark, path).collect()] == ["c"]
    with pytest.raises(Exception, match="nowhere|scheme|URI"):
        store.delete_objects(asked, "nowhere://bucket/x")


def test_backup_state_and_choice(spark):
    state = spark.createDataFrame([("s", "b1", 1), ("s", "b2", 0), ("s", "gone", 5)], "backup_set string, name string, age long")
    present = spark.createDataFrame([("s", "b1"), ("s", "b2"), ("s", "b3"), ("s", "b4"), ("t", "x")], "backup_set string, name string")
    assert {tuple(r) for r in versions.next_state(state, present).collect()} == {("s", "b1", 3), ("s", "b2", 2), ("s", "b3", 1), ("s", "b4", 0), ("t", "x", 0)}
    old = spark.createDataFrame([("s", f"b{a}", a) for a in range(40)], "backup_set string, name string, age long")
    kept = {r.name for r in versions.expire_backups(old, [1, 3, 7], most_deleted=1.0).where("keep").collect()}
    assert kept == versions.backups_to_keep([(f"b{a}", a) for a in range(39, -1, -1)], [1, 3, 7])
    assert versions.expire_backups(old, [1, 3, 7]).where("not keep").isEmpty()


def test_changes_that_must_hit_one_row(spark):
    from granary.operators import relational

    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, v string")
    assert sorted(map(tuple, relational.write_back(df, spark.createDataFrame([(1, "z")], df.schema)).collect())) == [(1, "z"), (2, "b"), (2, "c")]
    for bad in (2, 9):
        with pytest.raises(LookupError):
            relational.write_back(df, spark.createDataFrame([(bad, "z")], df.schema))
        with pytest.raises(LookupError):
            relational.delete_one(df, "id", bad)
    assert relational.delete_one(df, "id", 1).count() == 2
    watched, seen = relational.counted(df, F.col("id") == 2)
    assert watched.count() == 3 and seen.get["affected"] == 2


def test_throttle_lets_the_last_pass(spark):
    from granary.streaming import flows

    rows = [(k, "m", float(s), s == 3) for k, s in enumerate((0, 1, 3, 4, 13))]
    df = spark.createDataFrame(rows, "k long, name string, s double, is_last boolean")
    assert sorted(r.k for r in flows.throttle_batch(df, "name", F.col("s"), 10.0, "k", F.col("is_last")).collect()) == [0, 2, 4]


def test_failed_uploads_are_no_ones_copies(spark):
    from granary.operators import content

    objects = spark.createDataFrame([(1, "aa"), (2, "bb")], "id long, hash string")
    marked = content.mark_failed(objects, spark.createDataFrame([(2,)], "id long"))
    assert {tuple(r) for r in marked.select("id", "hash").collect()} == {(1, "aa"), (2, None)}


def test_plans_do_not_show_the_passphrase(spark):
    from granary.functions import codec

    objects = spark.createDataFrame([("k", b"data")], "key string, data binary")
    stored = codec.encode_objects(objects, "zlib", 1, "open sesame")
    plan = stored._jdf.queryExecution().toString()
    assert "open sesame" not in plan and "6F70656E" not in plan.upper()
    assert bytes(codec.decode_objects(stored, "open sesame").first().data) == b"data"
