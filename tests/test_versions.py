import pytest
from pyspark.sql import functions as F

from granary.operators import versions

# block -> ids by version (None: not there), sizes in blocks, versions kept, survivors by block
N = None
CASES = {
    "nodup": ({0: [10, 11, 12, 13, 14, 15], 1: [20, 21, 22, 23, 24, 25], 2: [30, 31, 32, 33, 34, 35], 3: [40, 41, 42, 43, 44, 45]}, [4] * 6, 3, {13, 14, 15, 23, 24, 25, 33, 34, 35, 43, 44, 45}),
    "dup1": ({0: [10, 11, 12, 13, 14, 15], 1: [20, 20, 20, 21, 22, 23], 2: [30, 31, 32, 33, 34, 35], 3: [40, 40, 41, 42, 43, 44]}, [4] * 6, 3, {13, 14, 15, 21, 22, 23, 33, 34, 35, 42, 43, 44}),
    "dup2": ({0: [10, 11, 12, 13, 14, 15], 1: [20, 20, 20, 21, 22, 23], 2: [30, 31, 32, 33, 34, 35], 3: [40, 40, 41, 42, 43, 44]}, [4] * 6, 4, {12, 13, 14, 15, 20, 21, 22, 23, 32, 33, 34, 35, 41, 42, 43, 44}),
    "dup3": ({0: [10, 11, 12, 13, 13, 13], 1: [20, 20, 20, 21, 22, 22], 2: [30, 31, 32, 33, 34, 35], 3: [40, 40, 41, 42, 43, 44]}, [4] * 6, 3, {13, 21, 22, 33, 34, 35, 42, 43, 44}),
    "smaller": ({0: [10, 11, 12, 13, 14, 15], 1: [20, 21, 22, 23, 24, 25], 2: [30, 31, 32, 33, N, N], 3: [40, 41, 42, N, N, N]}, [4, 4, 4, 3, 2, 2], 3, {13, 14, 15, 23, 24, 25, 33}),
    "downup": ({0: [10, 11, 12, 13, 13], 1: [20, 21, 23, 23, 24], 2: [30, 31, N, 33, 34], 3: [40, N, N, 40, N]}, [4, 3, 2, 4, 3], 3, {12, 13, 23, 24, 33, 34, 40}),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("grouped", [False, True])
def test_retention_matrices(spark, case, grouped):
    blocks, sizes, keep, survivors = CASES[case]
    rows, names = [], {}
    for b, ids in blocks.items():
        last = N
        for seq, i in enumerate(ids):
            if i is not N and i != last:
                rows.append(("g", b, seq))
                names[b, seq] = i
            last = i
    stored = spark.createDataFrame(rows, "g string, blockno long, seq_no long")
    params = spark.createDataFrame([("g", s, n) for s, n in enumerate(sizes)], "g string, seq_no long, n_blocks long")
    gone = versions.retention(stored, params, keep, ["g"] if grouped else None).collect()
    gone = {(r.blockno, r.seq_no) for r in gone}
    assert {names[b, s] for _, b, s in rows if (b, s) not in gone} == survivors


def test_snapshots_restore_every_version(spark):
    import hashlib

    images = [b"aaaabbbbcc", b"aaaaXXXXccdd", b"aaaaXXXX", b"zzzzXXXXccdde"]
    stored = spark.createDataFrame([], "blockno long, seq_no long, payload binary")
    params = []
    for seq, image in enumerate(images):
        current = spark.createDataFrame([(k, image[4 * k : 4 * k + 4]) for k in range(-(-len(image) // 4))], "blockno long, payload binary")
        stored = versions.incremental_snapshot(stored, current, seq)
        params.append((seq, len(image), 4, hashlib.sha256(image).hexdigest()))
    p = spark.createDataFrame(params, "seq_no long, db_size long, metadata_block_size int, db_sha256 string")
    assert stored.count() == 3 + 2 + 0 + 2
    for seq, image in enumerate(images):
        back = versions.restore(stored, p, seq)
        assert b"".join(bytes(r.payload) for r in back.orderBy("blockno").collect()) == image
        assert versions.restored_digest(back, 4).first().sha256 == params[seq][3]
    with pytest.raises(LookupError):
        versions.restore(stored, p, 9)


def test_backups():
    ages = [(f"b{k}", k) for k in range(12, -1, -1)]
    kept = versions.backups_to_keep(ages, [1, 3, 7])
    assert "b0" in kept and len(kept) >= 3
    for step in range(1):
        for low, high in ((0, 1), (1, 3), (3, 7)):
            assert any(low <= a + step < high for n, a in ages if n in kept)


def test_expire_guard(spark):
    df = spark.createDataFrame([("s", f"b{k}", k) for k in range(40)], "backup_set string, name string, age long")
    assert versions.expire_backups(df, [1, 2], most_deleted=0.5).where("keep").count() == 40
    assert versions.expire_backups(df, [1, 2], most_deleted=1.0).where("keep").count() < 5


def test_params(spark):
    p = spark.createDataFrame([(1, True, 0.0), (5, False, 0.0)], "seq_no long, needs_fsck boolean, last_modified double")
    assert versions.next_params(p, 1, 3.0).agg(F.max("seq_no")).first()[0] == 6
    up = versions.upgrade_params(p, {"seq_no": "seq"}, {"label": F.lit("x")}, ["seq", "label"])
    assert up.columns == ["seq", "label"]
