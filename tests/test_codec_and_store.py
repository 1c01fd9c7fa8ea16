import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import codec, scalar
from granary.operators import content, relational
from granary.sources import store
from granary.streaming import flows


@pytest.fixture(scope="module")
def objects(spark):
    return spark.createDataFrame([(f"data_{k}", bytes([k]) * (k * 50)) for k in range(20)], "key string, data binary")


@pytest.mark.parametrize("phrase", [None, "secret phrase"])
@pytest.mark.parametrize("algorithm", codec.ALGORITHMS)
def test_round_trip(objects, algorithm, phrase):
    back = codec.decode_objects(codec.encode_objects(objects, algorithm, 1, phrase), phrase)
    assert {(r.key, bytes(r.data), r.error) for r in back.collect()} == {(r.key, bytes(r.data), None) for r in objects.collect()}


def test_batches_of_many_bytes_are_taken_in_parts(spark):
    """What is made of a batch leaves the worker in parts, however many rows the batch has."""
    column = pa.array([b"a" * 700, None, b"", b"b" * 400, b"c" * 3000, b"d"], pa.binary())
    assert list(codec.parts_of(column, 1000)) == [(0, 3), (3, 1), (4, 1), (5, 1)]
    parts = list(codec._each(len, pa.int64())(iter([column.slice(1), column.slice(0, 0)])))
    assert [p.to_pylist() for p in parts] == [[None, 0, 400, 3000, 1], []]
    rows = [(k, None if k % 7 == 0 else bytes([k % 251]) * 20_000) for k in range(300)]
    data = spark.createDataFrame(rows, "k int, data binary").coalesce(1)
    back = data.select("k", codec.decompress(codec.compress(F.col("data"), "zlib", 1), F.lit("zlib")).alias("d")).select("k", "d.*")
    assert {r.k: (r.data and bytes(r.data), r.error) for r in back.collect()} == {k: (d, None if d else "missing") for k, d in rows}


def test_damage_is_refused(spark, objects):
    one = objects.where("key = 'data_7'")

    def error(stored, phrase=None):
        r = codec.decode_objects(stored, phrase).first()
        assert r.data is None
        return r.error

    plain, sealed = codec.encode_objects(one, "zlib"), codec.encode_objects(one, "zlib", 6, "p")
    sealed = sealed.sparkSession.createDataFrame(sealed.collect(), sealed.schema)
    assert error(plain.withColumn("format_version", F.lit(1))) == "format version"
    assert error(plain.withColumn("payload", F.expr("substring(payload, 1, length(payload) - 3)"))) == "premature end"
    assert error(plain.withColumn("payload", F.expr("concat(payload, X'00')"))) == "trailing data"
    assert error(plain.withColumn("payload", F.expr("X'0011'"))) == "corrupted"
    assert error(plain.withColumn("size", F.lit(3).cast("long"))) == "size"
    assert error(plain.withColumn("size", F.lit(None).cast("long"))) == "missing metadata"
    assert error(sealed) == "encrypted" and error(plain, "p") == "not encrypted"
    assert error(sealed, "wrong") == "signature"
    assert error(sealed.withColumn("key", F.lit("data_8")), "p") == "signature"
    assert error(sealed.withColumn("payload", F.expr("concat(substring(payload, 1, 20), X'00', substring(payload, 22, 1000))")), "p") == "signature"


def test_store(spark, objects, tmp_path):
    path = str(tmp_path / "store")
    odd = objects.where("length(data) > 0").unionByName(spark.createDataFrame([("a/b=c#d", b"odd")], objects.schema))
    store.write_objects(odd, path)
    store.write_objects(spark.createDataFrame([("data_1", b"new")], objects.schema), path)
    assert not [f for f in os.listdir(path) if ".tmp" in f]
    listing = {r.key: r.length for r in store.list_objects(spark, path).collect()}
    assert listing["a/b=c#d"] == 3 and len(listing) == 20 and listing["data_1"] == 3
    assert {r.key for r in store.list_objects(spark, path, "data_1").collect()} == {f"data_{k}" for k in (1, *range(10, 20))}
    assert bytes(store.read_objects(spark, path, "a/").first().data) == b"odd"
    assert store.delete_objects(spark.createDataFrame([("data_1",), ("never",)], "key string"), path).count() == 0
    assert store.list_objects(spark, path).count() == 19
    store.write_packed(objects, str(tmp_path / "packed"))
    assert store.table_bytes(spark, str(tmp_path / "packed")) > 0
    store.write_keys(objects.select("key"), str(tmp_path / "keys"))
    assert store.read_keys(spark, str(tmp_path / "keys")).count() == 20
    with pytest.raises(Exception, match="already exists"):
        store.write_keys(objects.select("key"), str(tmp_path / "keys"))


def test_small_sources(spark):
    keys = spark.createDataFrame([("metadata_00000000000a_0000000010",), ("metadata_bak_1",), ("params_00ff",), ("12-3",), ("12-3.tmp",), ("x",)], "key string")
    assert [tuple(r) for r in store.metadata_versions(keys).collect()] == [(10, 16)]
    assert [r.seq_no for r in store.params_versions(keys).collect()] == [255]
    assert {tuple(r) for r in store.cached_blocks(keys).collect()} == {(12, 3, False), (None, None, True)}
    config = store.config_options(spark, "[a]\nstorage-url: s3://x\nuser: u\n[b]\nstorage-url: s3://x/y\nuser: v\n[c]\nother: 1\n")
    urls = spark.createDataFrame([("s3://x/z",), ("s3://x/y/1",), ("gs://q",)], "url string")
    assert {tuple(r) for r in relational.prefix_match(urls, config, "position").collect()} == {("s3://x/z", "user", "u"), ("s3://x/y/1", "user", "v")}


def test_scalars(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert [one(scalar.pretty_size(F.lit(n).cast("long")))[0] for n in (0, 1023, 1024, 1152, 20 * 1024, 300 * 1024, 5 << 20, 3 << 30, 2 << 40)] == ["0 bytes", "1023 bytes", "1.00 KiB", "1.12 KiB", "20.0 KiB", "300 KiB", "5.00 MiB", "3.00 GiB", "2.00 TiB"]
    assert one(scalar.escape_path(F.lit("/a_b/c")))[0] == "a__b_c"
    assert one(scalar.text_of(F.lit(b"a\xffb")))[0] == "a�b"
    assert one(scalar.split_every(F.lit("abcde"), 2))[0] == ["ab", "cd", "e"] and one(scalar.split_every(F.lit(""), 2))[0] == []
    assert one(scalar.key_path(F.lit(1234567)))[0] == "123/123456/1234567" and one(scalar.key_path(F.lit(999)))[0] == "999"
    assert one(scalar.url_quote(F.lit("a b/c+d")))[0] == "a%20b/c%2Bd"
    assert one(scalar.freeze_mapping(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))))[0] == '{"a":2,"b":1}'
    long = spark.createDataFrame([(1, 1, "x" * 300), (1, 2, "n"), (1, 3, "n")], "parent int, id int, name string")
    taken = spark.createDataFrame([(1, "n"), (1, "n-1"), (1, "n-7")], "parent int, name string")
    assert {r.id: r.new_name for r in scalar.unique_names(long, taken).collect()} == {1: "x" * 120 + " ... " + "x" * 120, 2: "n-2", 3: "n-3"}


def test_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    with pytest.raises(relational.NoRow):
        relational.one_row(df.where("id = 9"))
    with pytest.raises(relational.NotUnique):
        relational.one_value(df)
    assert relational.value_or_none(df.where("id = 9")) is None and relational.has_rows(df)
    assert relational.typed(df, "id int, v string").schema["id"].dataType.simpleString() == "int"
    df.createOrReplaceTempView("rows_view")
    assert relational.query(spark, "SELECT v FROM rows_view WHERE id = ?", 1).first().v == "a"


def test_dedup_steps(spark):
    """Three blocks and payloads, as references come and go."""
    one = lambda h: spark.createDataFrame([(h, 1)], "hash string, length long")
    objects = spark.createDataFrame([], "hash string, refcount long, phys_size long, length long")

    def step(new, old=None):
        nonlocal objects
        before = {r.hash for r in objects.collect()}
        objects = content.dedup_insert(objects, one(new)).withColumn("phys_size", F.lit(1).cast("long"))
        gone = 0
        if old:
            objects, deleted = content.dereference(objects, one(old))
            gone = deleted.count()
        objects = spark.createDataFrame(objects.collect(), objects.schema)
        return len({new} - before), gone

    assert [step("d1"), step("d1"), step("d2", "d1"), step("d3", "d1"), step("d2", "d3"), step("d1"), step("d1", "d2")] == [(1, 0), (0, 0), (1, 0), (1, 1), (0, 1), (1, 0), (0, 0)]


def test_lru(spark):
    df = spark.createDataFrame([("c", i, k, 1) for i, k in enumerate("abacbda")], "cache string, seq long, key string, bytes long")
    got = content.lru_cache(df, 100, 2).orderBy("seq").collect()
    assert [r.hit for r in got] == [False, False, True, False, False, False, False] and sum(r.evicted for r in got) == 4


def plain_lru(accesses, max_bytes, max_entries):
    """hit and evicted by seq, with each cache as a list of (key, bytes), the least recent first."""
    caches, out = {}, {}
    for cache, seq, key, size in sorted(accesses, key=lambda a: (a[1], a[2])):
        before = caches.get(cache, [])
        now = [e for e in before if e[0] != key] + [(key, size or 0)]
        gone = 0
        while len(now) > 1 and (len(now) > max_entries or sum(n for _, n in now) > max_bytes):
            now, gone = now[1:], gone + 1
        out[seq] = (any(k == key for k, _ in before), gone)
        caches[cache] = now
    return out


def test_lru_like_a_plain_replay(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, f"k{rng.randrange(12)}", rng.choice([1, 3, 8, 40, None])) for i in range(900)]
    df = spark.createDataFrame(rows, "cache string, seq long, key string, bytes long").repartition(5)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a cache crosses batches
    try:
        for limits in ((30, 5), (10_000, 3), (12, 100)):
            got = content.lru_cache(df, *limits)
            assert {r.seq: (r.hit, r.evicted) for r in got.collect()} == plain_lru(rows, *limits)
        assert got.columns == ["cache", "seq", "key", "hit", "evicted"] and content.lru_cache(df.limit(0), 30, 5).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", 0), (2, "a", 5), (3, "b", 6), (4, "a", 30), (5, "b", 500), (6, "a", 501), (7, "c", 2000)], "event_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: flows.event_stream(spark, str(tmp_path / "in"))
    flows.append(flows.idle_sessions(stream(), ["k"], "ts", "10 seconds", "1 second"), str(tmp_path / "idle"), str(tmp_path / "c1")).awaitTermination()
    idle = {(r.k, r.writes) for r in spark.read.parquet(str(tmp_path / "idle")).collect()}
    assert idle >= {("a", 2), ("a", 1), ("b", 1)}
    flows.append(flows.throttle(stream().drop("ts"), "k", F.col("s"), 20.0, "event_id"), str(tmp_path / "thr"), str(tmp_path / "c2")).awaitTermination()
    passed = {r.event_id for r in spark.read.parquet(str(tmp_path / "thr")).collect()}
    assert passed == {1, 3, 4, 5, 6, 7} == {r.event_id for r in flows.throttle_batch(events.drop("ts"), "k", F.col("s"), 20.0, "event_id").collect()}
    flows.append(flows.once(stream(), ["k"], "ts", "1 hour"), str(tmp_path / "once"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3
    seen = []
    flows.drain(stream(), lambda df, _: seen.append(df.count()), str(tmp_path / "c4")).awaitTermination()
    assert sum(seen) == 7
