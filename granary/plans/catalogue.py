"""Every query of the storage-analytics side, with the DuckDB SQL that checks it.

Files are `documents`, their blocks are BLOCK characters long; names and directories come from page urls; `events` is a
log of writes. Each query calls the operator of its name on whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import codec, scalar
from granary.operators import checks, content, relational, stats, tree, versions
from granary.operators.storage import assign_ids, saved, shared_folder
from granary.plans.schema import CONTROL, DIRECTORY, REGULAR, ROOT, SYMLINK, Tables
from granary.sources import store
from granary.streaming import flows

BLOCK = 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.with_hash(content.chunk(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", BLOCK))


def _seconds(c: str = "ts"):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


_B = f"b AS (SELECT doc_id, blockno, substr(text, blockno * {BLOCK} + 1, {BLOCK}) AS data FROM (SELECT doc_id, text, unnest(range((length(text) + {BLOCK - 1}) // {BLOCK})) AS blockno FROM documents)), h AS (SELECT doc_id, blockno, data, length(data) AS length, sha256(data) AS hash FROM b)"
_SEG = "seg AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')) AS name FROM pages)"
_URL_TREE = "p AS (SELECT DISTINCT string_split(rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), '/') AS s FROM pages), e AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS parent, array_to_string(s[1:i+1], '/') AS child FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p))"


# --- content -------------------------------------------------------------------------------------------------


@_query(f"WITH {_B} SELECT (SELECT count(*) FROM documents) AS files, sum(n)::BIGINT AS blocks, count(*) AS objects, sum(n * length)::BIGINT AS total_size, sum(length)::BIGINT AS unique_size, round(100.0 * sum(length) / sum(n * length), 4) AS dedup_pct FROM (SELECT hash, count(*) AS n, max(length) AS length FROM h GROUP BY hash)")
def dedup_stats(spark, sf_dir):
    return content.dedup_stats(_blocks(spark, sf_dir), _t(spark, sf_dir, "documents").select("doc_id"))


@_query(f"WITH {_B} SELECT doc_id, blockno::BIGINT AS blockno, length, hash FROM h")
def block_map(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "blockno", "length", "hash")


@_query(f"WITH {_B} SELECT hash, count(*) AS refcount, max(length) AS length FROM h GROUP BY hash")
def object_table(spark, sf_dir):
    return content.object_table(_blocks(spark, sf_dir))


@_query(f"WITH {_B} SELECT hash, count(*) AS refcount, max(length) AS length FROM h GROUP BY hash HAVING count(*) > 1")
def shared_blocks(spark, sf_dir):
    return content.object_table(_blocks(spark, sf_dir)).where("refcount > 1")


@_query(f"WITH {_B} SELECT hash, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS refcount, CASE WHEN max(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) = 1 THEN 100 ELSE -1 END AS phys_size, max(length) AS length FROM h GROUP BY hash")
def dedup_insert(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    old = content.object_table(blocks.where("doc_id % 2 = 0")).withColumn("phys_size", F.lit(100).cast("long"))
    return content.dedup_insert(old.select("hash", "refcount", "phys_size", "length"), blocks.where("doc_id % 2 = 1")).withColumn("phys_size", F.col("phys_size").cast("int"))


@_query(f"WITH {_B}, o AS (SELECT hash, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS gone, max(length) AS length FROM h GROUP BY hash) SELECT hash, n - gone AS refcount FROM o WHERE n > gone")
def dereference(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    left, _ = content.dereference(content.object_table(blocks).withColumn("phys_size", F.col("length")), blocks.where("doc_id % 3 = 0").select("hash"))
    return left.select("hash", "refcount")


@_query(f"WITH {_B} SELECT hash, CASE WHEN hash LIKE '%0' THEN count(*) + 1 ELSE count(*) END AS refcount, count(*) AS counted FROM h GROUP BY hash HAVING hash LIKE '%0'")
def refcount_mismatch(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    stored = content.object_table(blocks).select("hash", (F.col("refcount") + F.when(F.col("hash").endswith("0"), 1).otherwise(0)).alias("refcount"))
    counted = content.object_table(blocks).select("hash", F.col("refcount").alias("counted"))
    return stored.join(counted, "hash", "left").where(~F.col("refcount").eqNullSafe(F.col("counted")))


@_query(f"WITH {_B} SELECT count(*) FILTER (hash IS NULL OR hash LIKE '0%') AS failed, count(DISTINCT CASE WHEN hash NOT LIKE '0%' THEN hash END) AS objects FROM h")
def failed_uploads(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).withColumn("hash", F.when(~F.col("hash").startswith("0"), F.col("hash")))
    return relational.beside(blocks.agg(F.count_if(F.col("hash").isNull()).alias("failed")), content.object_table(blocks).agg(F.count("*").alias("objects")))


@_query("SELECT doc_id, encode(text)[1501:4500] AS data FROM documents WHERE octet_length(encode(text)) > 1500")
def read_range(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    blocks = content.chunk(docs, "doc_id", "text", BLOCK)
    return content.read_range(blocks, docs.select("doc_id", F.length("text").cast("long").alias("size")), "doc_id", BLOCK, 1500, 3000)


@_query(f"WITH {_B} SELECT doc_id, blockno::BIGINT AS blockno, CASE WHEN doc_id % 4 = 0 THEN substr(data, 1, (1500 - blockno * {BLOCK})::INT) ELSE data END AS data FROM h WHERE doc_id % 4 <> 0 OR blockno * {BLOCK} < 1500")
def truncate_blocks(spark, sf_dir):
    sizes = _t(spark, sf_dir, "documents").where("doc_id % 4 = 0").select("doc_id", F.lit(1500).cast("long").alias("size"))
    return content.truncate(_blocks(spark, sf_dir).select("doc_id", "blockno", "data"), sizes, "doc_id", BLOCK)


_WRITES = [(1000, "A" * 100, 1), (1000, "B" * 100, 2), (1600, "C" * 30, 3)]


# bytes as hex digits, two each: what is past the end of a text is filled with zero bytes before it is written over
@_query("SELECT doc_id, sha256(unhex(substr(h, 1, 2000) || repeat('42', 100) || substr(h, 2201, 1000) || repeat('43', 30) || substr(h, 3261))) AS hash FROM (SELECT doc_id, rpad(hex(encode(coalesce(text, ''))), greatest(2 * octet_length(encode(coalesce(text, ''))), 3260)::INT, '0') AS h FROM documents)")
def apply_writes(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    base = content.chunk(docs, "doc_id", "text", BLOCK).select("doc_id", "blockno", "data")
    write = F.explode(F.array(*[F.struct(F.lit(o).cast("long").alias("offset"), F.lit(d).alias("data"), F.lit(v).alias("version")) for o, d, v in _WRITES]))
    new = content.apply_writes(base, docs.select("doc_id", write.alias("w")).select("doc_id", "w.offset", "w.data", "w.version"), "doc_id", BLOCK)
    files = docs.select("doc_id", F.length("text").cast("long").alias("size"))
    sizes = content.sizes_after_writes(files, docs.select("doc_id", write.alias("w")).select("doc_id", "w.offset", "w.data"), "doc_id")
    return content.read_range(new, sizes, "doc_id", BLOCK, 0, 2**31 - 1).select("doc_id", F.sha2("data", 256).alias("hash"))


@_query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 11 = 0 AND length(text) > 0 THEN 'size' WHEN doc_id % 7 = 0 THEN 'hash' ELSE 'ok' END AS status FROM documents")
def verify_objects(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    objects = docs.select("doc_id", F.length("data").cast("long").alias("length"), F.sha2("data", 256).alias("hash"))
    damaged = F.when(F.col("doc_id") % 11 == 0, F.substring("data", F.lit(2), F.length("data"))).when(F.col("doc_id") % 7 == 0, F.concat(F.substring("data", F.lit(2), F.length("data")), F.lit("~").cast("binary"))).otherwise(F.col("data"))
    return content.verify_objects(objects, docs.where("doc_id % 5 <> 0").withColumn("data", damaged), "doc_id")


@_query(f"WITH {_B} SELECT doc_id, blockno::BIGINT AS blockno, CASE WHEN doc_id % 3 = 0 THEN 'relink' WHEN doc_id % 3 = 1 THEN 'keep' ELSE 'add' END AS action FROM h")
def commit_cache(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).select(F.col("doc_id").alias("inode"), "blockno", "hash")
    cached = blocks.withColumn("hash", F.when(F.col("inode") % 3 == 0, F.reverse("hash")).otherwise(F.col("hash")))
    return content.commit_cache(blocks.where("inode % 3 <> 2"), cached).select(F.col("inode").alias("doc_id"), "blockno", "action")


@_query(f"WITH {_B} SELECT hash, count(*) AS refcount FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN reverse(hash) ELSE hash END AS hash FROM h) GROUP BY hash")
def apply_cache(spark, sf_dir):
    """Every third file changed in the cache, every third one only there: the objects after committing it."""
    blocks = _blocks(spark, sf_dir).select(F.col("doc_id").alias("inode"), "blockno", "hash", "length")
    stored = blocks.where("inode % 3 <> 2")
    objects = content.object_table(stored).select("hash", "refcount", F.col("length").cast("long").alias("phys_size"), "length")
    cached = blocks.withColumn("hash", F.when(F.col("inode") % 3 == 0, F.reverse("hash")).otherwise(F.col("hash")))
    mapping, left, _ = content.apply_cache(stored.drop("length"), objects, cached)
    return left.select("hash", "refcount").join(mapping.select("hash").distinct(), "hash", "full")


@_query(f"WITH {_B} SELECT hash, count(*) AS refcount FROM h WHERE NOT (doc_id % 4 = 0 AND blockno >= 1 AND blockno < 3) GROUP BY hash")
def remove_range(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    objects = content.object_table(blocks).withColumn("phys_size", F.col("length"))
    _, left, _ = content.remove_range(blocks.select("doc_id", "blockno", "hash"), objects, "doc_id", 1, 3, _t(spark, sf_dir, "documents").where("doc_id % 4 = 0"))
    return left.select("hash", "refcount")


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5000")
def verify_in_order(spark, sf_dir):
    return content.verify_in_order(_t(spark, sf_dir, "orders").select("o_orderkey"), 5000, "o_orderkey")


@_query("SELECT doc_id, ['none', 'zlib', 'bzip2', 'lzma'][doc_id % 4 + 1] AS compression, CAST(NULL AS VARCHAR) AS error, sha256(text) AS hash FROM documents")
def codec_roundtrip(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("data"))
    out = None
    for k, algorithm in enumerate(codec.ALGORITHMS):
        phrase = "test phrase" if k % 2 else None
        stored = codec.encode_objects(docs.where(F.col("doc_id") % 4 == k).select("key", "data"), algorithm, 1, phrase)
        back = codec.decode_objects(stored, phrase).select(F.col("key").cast("long").alias("doc_id"), F.lit(algorithm).alias("compression"), "error", F.sha2("data", 256).alias("hash"))
        out = back if out is None else out.unionByName(back)
    return out


# --- relational core -----------------------------------------------------------------------------------------


@_query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def dangling_fk(spark, sf_dir):
    return relational.dangling(_t(spark, sf_dir, "orders"), "o_orderkey", _t(spark, sf_dir, "lineitem"), "l_orderkey").select("o_orderkey")


_KEYS = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id")]


@_query(" UNION ALL ".join(f"SELECT '{a}' AS src_table, '{c}' AS src_column, '{b}' AS dst_table, count(*) AS violations FROM {a} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {b} y WHERE y.{k} = x.{c})" for a, c, b, k in _KEYS))
def fk_report(spark, sf_dir):
    return relational.foreign_key_report({n: _t(spark, sf_dir, n) for k in _KEYS for n in (k[0], k[2])}, _KEYS)


@_query(f"WITH {_B} SELECT d.doc_id, length(text) - 1 AS size, m.min_size FROM documents d JOIN (SELECT doc_id, max(blockno * {BLOCK} + length)::BIGINT AS min_size FROM h GROUP BY doc_id) m USING (doc_id) WHERE d.doc_id % 3 = 0")
def min_size_check(spark, sf_dir):
    t = _file_tables(spark, sf_dir)
    return checks.detect_sizes(t, BLOCK).select(F.col("id").alias("doc_id"), "size", "min_size")


def _file_tables(spark, sf_dir) -> Tables:
    """Documents as inodes; every third one is recorded one character too small."""
    docs = _t(spark, sf_dir, "documents")
    zero = F.lit(0).cast("long")
    inodes = docs.select(F.col("doc_id").alias("id"), *[zero.alias(c) for c in ("uid", "gid")], F.lit(REGULAR).cast("long").alias("mode"), *[zero.alias(c) for c in ("mtime_ns", "atime_ns", "ctime_ns")], F.lit(1).cast("long").alias("refcount"), (F.length("text") - F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("long").alias("size"), zero.alias("rdev"), F.lit(False).alias("locked"))
    blocks = _blocks(spark, sf_dir).select(F.col("doc_id").alias("inode"), "blockno", F.xxhash64("hash").alias("obj_id"), F.unhex("hash").alias("hash"), "length")
    objects = blocks.groupBy("obj_id").agg(F.first("hash").alias("hash"), F.count("*").alias("refcount"), F.max("length").alias("length")).select(F.col("obj_id").alias("id"), "hash", "refcount", F.col("length").alias("phys_size"), "length")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    return Tables(objects, inodes, blocks.select("inode", "blockno", "obj_id"), empty("inode long, target binary"), empty("id long, name binary, refcount long"), empty("rowid long, name_id long, inode long, parent_inode long"), empty("inode long, name_id long, value binary"))


@_query(f"WITH {_SEG} SELECT name, count(*) AS refcount FROM seg GROUP BY name")
def names_intern(spark, sf_dir):
    url = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    uses = _t(spark, sf_dir, "pages").select(F.explode(F.split(url, "/")).alias("name"))
    names = uses.distinct().select(F.col("name").alias("id"), F.lit(0).cast("long").alias("refcount"))
    return relational.recount(names, "id", "refcount", [(uses, "name")]).select(F.col("id").alias("name"), "refcount")


@_query("SELECT doc_id, 'documents' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labels' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def except_both_ways(spark, sf_dir):
    return relational.differences(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id"), ("documents", "labels"))


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf_dir):
    return relational.keyset_page(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 100)


@_query("SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank BETWEEN 2 AND 4")
def topn_versions(spark, sf_dir):
    return relational.latest_n(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 1).select("o_custkey", "o_orderkey", "rank")


@_query("SELECT c.event_id, arg_max(p.event_id, row(p.ts, p.event_id)) AS purchase_id FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.ts <= c.ts AND p.event_type = 'purchase' WHERE c.event_type = 'click' GROUP BY c.event_id")
def asof_block(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return relational.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'"), "user_id", "ts", F.col("event_id"), "purchase_id").select("event_id", "purchase_id")


@_query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_wins(spark, sf_dir):
    return relational.last_wins(_t(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_custkey % 100 = 0")
def upsert(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("NEW")).unionByName(c.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")))
    return relational.upsert(c.where("c_custkey % 3 <> 1"), new, ["c_custkey"])


@_query("SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b USING (o_custkey)")
def grouped_upsert(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return relational.add_counts(o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.count("*").alias("n")), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "n")


@_query("SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier")
def update_in(spark, sf_dir):
    ids = _t(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")
    return relational.update_in(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", ids, {"s_nationkey": F.lit(-1)})


@_query("SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE NOT coalesce(quality = 0, false)")
def delete_where(spark, sf_dir):
    joined = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return relational.delete_where(joined, F.col("quality") == 0)


@_query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer")
def write_back(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("c_nationkey"))
    return relational.write_back(c, c.where("c_custkey % 10 = 0").withColumn("c_nationkey", F.col("c_nationkey") + 100), "c_custkey")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey + 10000000, l_linenumber FROM lineitem WHERE l_orderkey % 50 = 0")
def insert_select(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    ids = items.where("l_orderkey % 50 = 0").select(F.col("l_orderkey").alias("old"), (F.col("l_orderkey") + 10000000).alias("new")).distinct()
    return relational.insert_select(items, "l_orderkey", ids)


@_query("SELECT c.c_custkey, c.c_nationkey AS refcount, coalesce(n, 0) AS counted FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey IS DISTINCT FROM coalesce(n, 0)")
def link_counts(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("int").alias("refcount"))
    counted = relational.recount(c, "id", "refcount", [(_t(spark, sf_dir, "orders"), "o_custkey")]).select("id", F.col("refcount").alias("counted"))
    return c.join(counted, "id").where(~F.col("refcount").eqNullSafe(F.col("counted"))).withColumnRenamed("id", "c_custkey")


@_query("SELECT n.n_nationkey, count(x.k) AS refcount FROM nation n LEFT JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x ON x.k = n.n_nationkey GROUP BY 1")
def name_refcounts(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey", F.lit(0).cast("long").alias("refcount"))
    return relational.recount(n, "n_nationkey", "refcount", [(_t(spark, sf_dir, "customer"), "c_nationkey"), (_t(spark, sf_dir, "supplier"), "s_nationkey")])


_PATTERNS = [("http://", "scheme", "plain", 0), ("https://", "scheme", "secure", 1), ("https://www.", "scheme", "www", 2), ("http", "any", "yes", 3), ("https://m.", "mobile", "yes", 4)]


@_query("WITH c(pattern, option, value, position) AS (VALUES " + ", ".join(map(str, _PATTERNS)) + ") SELECT url, option, arg_max(value, position) AS value FROM (SELECT DISTINCT url FROM pages) p JOIN c ON starts_with(p.url, c.pattern) GROUP BY 1, 2")
def config_prefix(spark, sf_dir):
    return relational.prefix_match(_t(spark, sf_dir, "pages").select("url"), spark.createDataFrame(_PATTERNS, "pattern string, option string, value string, position int"), "position")


# --- ordered figures -----------------------------------------------------------------------------------------


@_query("SELECT o_orderkey, coalesce(sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done FROM orders")
def progress_sum(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return relational.running_sum(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents", "done").select("o_orderkey", "done")


@_query("SELECT event_type, second, n, sum(n) OVER (PARTITION BY event_type ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)::BIGINT AS in_window, sum(n) OVER (PARTITION BY event_type ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)::DOUBLE / 3600 AS rate FROM (SELECT event_type, floor(epoch(ts))::BIGINT AS second, count(*) AS n FROM events GROUP BY 1, 2)")
def rate_window(spark, sf_dir):
    return relational.sliding_rate(_t(spark, sf_dir, "events"), ["event_type"], _seconds(), 3600)


@_query("WITH s AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events), n AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS nx, (SELECT max(s) FROM s) AS horizon FROM s) SELECT event_id, user_id, s + 86400 AS committed_at FROM n WHERE coalesce(nx, horizon) - s >= 86400")
def idle_commit(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    horizon = e.agg(F.max(_seconds())).first()[0] or 0
    return relational.idle_commits(e, ["user_id"], _seconds(), 86400, horizon).select("event_id", "user_id", "committed_at")


@_query("WITH RECURSIVE s AS (SELECT event_id, user_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS k FROM events), r AS (SELECT event_id, user_id, s, k FROM s WHERE k = 1 UNION ALL SELECT x.event_id, x.user_id, x.s, x.k FROM r JOIN LATERAL (SELECT * FROM s WHERE s.user_id = r.user_id AND s.k > r.k AND s.s - r.s >= 604800 ORDER BY s.k LIMIT 1) x ON true) SELECT event_id, user_id FROM r")
def throttle(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return flows.throttle_batch(e, "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 604800.0, "event_id").select("event_id", "user_id")


@_query("SELECT min(event_id) AS event_id, event_type, floor(value)::BIGINT AS v FROM events GROUP BY event_type, floor(value)")
def log_dedup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").alias("v"))
    return relational.last_wins(e, ["event_type", "v"], [-F.col("event_id")])


_ISLANDS = "WITH k AS (SELECT o_orderkey // 1000 AS bucket, o_orderkey AS n FROM orders), r AS (SELECT bucket, min(n) AS first, max(n) AS last, count(*) AS size FROM (SELECT bucket, n, n - row_number() OVER (PARTITION BY bucket ORDER BY n) AS g FROM k) GROUP BY bucket, g)"


def _gappy(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.expr("o_orderkey div 1000").alias("bucket"), F.col("o_orderkey").alias("n"))


@_query(f"{_ISLANDS} SELECT bucket, first, last, size FROM r")
def gaps_islands(spark, sf_dir):
    return relational.islands(_gappy(spark, sf_dir), ["bucket"], "n")


@_query(f"{_ISLANDS}, p AS (SELECT bucket, list(x ORDER BY first) AS x FROM (SELECT bucket, first, CASE WHEN last - first > 1 THEN first || '-' || last WHEN last > first THEN first || ', ' || last ELSE first::VARCHAR END AS x FROM r) GROUP BY bucket), f AS (SELECT bucket, string_split(array_to_string(x, ', '), ', ') AS y FROM p) SELECT bucket, CASE WHEN len(y) > 1 THEN array_to_string(y[:-2], ', ') || ' and ' || y[-1] ELSE y[1] END AS numbers FROM f")
def number_list(spark, sf_dir):
    return scalar.number_list(_gappy(spark, sf_dir), ["bucket"], "n")


# --- versions ------------------------------------------------------------------------------------------------


@_query(f"WITH {_B}, n AS (SELECT doc_id, blockno, CASE WHEN doc_id % 7 = 0 THEN sha256(upper(data)) ELSE hash END AS hash FROM h WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id + 1000000, blockno, hash FROM h WHERE doc_id % 11 = 0) SELECT coalesce(h.doc_id, n.doc_id) AS doc_id, coalesce(h.blockno, n.blockno)::BIGINT AS blockno, CASE WHEN h.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM h FULL JOIN n ON h.doc_id = n.doc_id AND h.blockno = n.blockno WHERE h.hash IS DISTINCT FROM n.hash")
def snapshot_diff(spark, sf_dir):
    old = _blocks(spark, sf_dir)
    new = old.where("doc_id % 10 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.upper("data").cast("binary"), 256)).otherwise(F.col("hash")))
    new = new.unionByName(old.where("doc_id % 11 = 0").withColumn("doc_id", F.col("doc_id") + 1000000))
    return versions.snapshot_diff(old, new, ["doc_id", "blockno"])


def _event_versions(spark, sf_dir):
    day = F.expr("unix_date(cast(ts as date))").cast("long")
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("blockno"), day.alias("seq_no")).distinct()


_V = "v AS (SELECT DISTINCT user_id AS blockno, (ts::DATE - DATE '1970-01-01')::BIGINT AS seq_no FROM events)"


@_query(f"WITH {_V}, n AS (SELECT *, lead(seq_no) OVER (PARTITION BY blockno ORDER BY seq_no) AS nx FROM v), k AS (SELECT DISTINCT seq_no FROM v ORDER BY seq_no DESC LIMIT 5) SELECT blockno, seq_no FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.seq_no >= n.seq_no AND (nx IS NULL OR k.seq_no < nx))")
def retention_keep(spark, sf_dir):
    v = _event_versions(spark, sf_dir)
    params = v.select("seq_no").distinct().withColumn("n_blocks", F.lit(2**40))
    return versions.retention(v, params, 5)


@_query(f"WITH {_V} SELECT blockno, max(seq_no) AS seq_no FROM v WHERE seq_no <= (SELECT avg(seq_no)::BIGINT FROM v) GROUP BY blockno")
def asof_snapshot(spark, sf_dir):
    v = _event_versions(spark, sf_dir)
    target = v.agg(F.round(F.avg("seq_no")).cast("long")).first()[0] or 0
    return versions.as_of_blocks(v, F.lit(target)).select("blockno", "seq_no")


ORACLE["asof_snapshot"] = ORACLE["asof_snapshot"].replace("avg(seq_no)::BIGINT", "round(avg(seq_no))::BIGINT")


@_query("WITH d AS (SELECT DISTINCT event_type, floor(epoch(ts) / 7200)::BIGINT * 7200 AS s FROM events), g AS (SELECT *, s - lag(s) OVER (PARTITION BY event_type ORDER BY s) AS gap FROM d), a AS (SELECT event_type, s, min(gap) OVER (PARTITION BY event_type) AS step, (SELECT max(s) + 9000 FROM d) - s AS age FROM g) SELECT event_type, s, step, age, ceil(age / step)::BIGINT AS cycles FROM a")
def backup_ages(spark, sf_dir):
    d = saved(_t(spark, sf_dir, "events").select("event_type", (F.floor(_seconds() / 7200) * 7200).alias("s")).distinct())
    now = (d.agg(F.max("s")).first()[0] or 0) + 9000
    return versions.backup_ages(d, ["event_type"], "s", F.lit(now))


@_query()
def expire_backups(spark, sf_dir):
    ages = backup_ages(spark, sf_dir).select(F.col("event_type").alias("backup_set"), F.concat(F.lit("b"), F.col("s").cast("string")).alias("name"), F.col("cycles").alias("age"))
    return versions.expire_backups(ages, [1, 3, 7, 14, 31, 150, 300], most_deleted=1.0)


@_query("SELECT event_type AS backup_set, 'b' || s AS name, (row_number() OVER (PARTITION BY event_type ORDER BY s DESC) - 1)::BIGINT AS age FROM (SELECT DISTINCT event_type, strftime(ts, '%Y%m%d') AS s FROM events) WHERE right(s, 1) <> '3' OR s > (SELECT strftime(avg(epoch(ts)).to_timestamp(), '%Y%m%d') FROM events)")
def backup_state(spark, sf_dir):
    """A state of the days in the first half, some of which are gone, and the days of the second half as new backups."""
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("backup_set"), F.concat(F.lit("b"), F.date_format("ts", "yyyyMMdd")).alias("name")).distinct()
    half = _t(spark, sf_dir, "events").agg(F.date_format(F.timestamp_seconds(F.avg(_seconds())), "yyyyMMdd")).first()[0] or ""
    e = saved(e.withColumn("old", F.col("name") <= F.lit("b" + half)))
    newest = F.row_number().over(Window.partitionBy("backup_set").orderBy(F.desc("name"))) - 1
    state = e.where("old").where(~F.col("name").endswith("3")).withColumn("age", newest.cast("long"))
    return versions.next_state(state.select("backup_set", "name", "age"), e.where(~(F.col("old") & F.col("name").endswith("3"))))


@_query("SELECT 'fs' || c_custkey AS label, CASE WHEN c_custkey % 4 = 0 THEN 'no local copy' WHEN c_custkey % 4 = 1 THEN 'local outdated' WHEN c_custkey % 4 = 2 THEN 'local newer' WHEN c_custkey % 3 = 0 THEN 'mounted elsewhere' WHEN c_custkey % 5 = 0 THEN 'needs check' WHEN c_acctbal < 0 THEN 'check due' ELSE 'clean' END AS state FROM customer")
def reconcile(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    label, k = F.concat(F.lit("fs"), F.col("c_custkey").cast("string")).alias("label"), F.col("c_custkey")
    remote = c.select(label, F.lit(10).alias("seq_no"), (k % 3 == 0).alias("is_mounted"), (k % 5 == 0).alias("needs_fsck"), F.when(F.col("c_acctbal") < 0, 0.0).otherwise(5e6).alias("last_fsck"))
    local = c.where("c_custkey % 4 <> 0").select(label, F.when(k % 4 == 1, 9).when(k % 4 == 2, 11).otherwise(10).alias("seq_no"))
    return versions.reconcile(local, remote, 5e6)


# --- trees ---------------------------------------------------------------------------------------------------


@_query("WITH RECURSIVE r AS (SELECT conv_id, turn, '' AS path FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, r.path || '/' || c.role FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1) SELECT DISTINCT conv_id, turn, path FROM r")
def path_of(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(*(F.struct(F.col("conv_id").cast("long").alias("conv_id"), (F.col("turn").cast("long") - k).alias("turn")).alias(c) for k, c in enumerate(("child", "parent"))), F.col("role").alias("name"), "turn")
    out = tree.paths(c.where("turn > 0"), c.where("turn = 0").select(F.col("child").alias("node")).distinct())
    return out.select("node.conv_id", "node.turn", "path")


def _url_edges(spark, sf_dir):
    parts = F.split(F.expr("rtrim('/', regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''))"), "/")
    s = _t(spark, sf_dir, "pages").select(parts.alias("s")).distinct().where(F.size("s") > 1)
    e = s.select("s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("i"))
    return e.select(F.expr("array_join(slice(s, 1, i), '/')").alias("parent"), F.expr("array_join(slice(s, 1, i + 1), '/')").alias("child")).distinct()


@_query(f"WITH RECURSIVE {_URL_TREE}, r AS (SELECT DISTINCT parent AS node, 0 AS depth FROM e WHERE parent LIKE 'blog.%' AND parent NOT LIKE '%/%' UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.node) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node")
def subtree(spark, sf_dir):
    e = saved(_url_edges(spark, sf_dir))
    return tree.reachable(e, e.where("parent like 'blog.%' and parent not like '%/%'").select("parent"))


@_query(f"WITH RECURSIVE {_URL_TREE}, hosts AS (SELECT DISTINCT parent AS host FROM e WHERE parent NOT LIKE '%/%'), g AS (SELECT parent, child FROM e UNION SELECT '', host FROM hosts WHERE host NOT LIKE 'm.%' UNION SELECT child, split_part(child, '/', 1) FROM e WHERE child LIKE 'm.%'), r AS (SELECT '' AS node UNION SELECT g.child FROM r JOIN g ON g.parent = r.node) SELECT DISTINCT x.node FROM (SELECT parent AS node FROM g UNION SELECT child FROM g) x WHERE x.node NOT IN (SELECT node FROM r)")
def unreachable(spark, sf_dir):
    e = saved(_url_edges(spark, sf_dir))
    hosts = e.where("parent not like '%/%'").select(F.col("parent").alias("child")).distinct()
    loops = e.where("child like 'm.%'").select(F.col("child").alias("parent"), F.expr("split(child, '/')[0]").alias("child"))
    g = saved(e.unionByName(hosts.where("child not like 'm.%'").select(F.lit("").alias("parent"), "child")).unionByName(loops))
    nodes = g.select(F.col("parent").alias("node")).unionByName(g.select(F.col("child").alias("node"))).distinct()
    return tree.unreachable(g, nodes, spark.range(1).select(F.lit("").alias("node")))


# The file system of page urls: hosts below the root, a directory where a url goes on, else a file of one block.
_FS = f"{_URL_TREE}, i AS (SELECT node, 9 + row_number() OVER (ORDER BY encode(node)) AS id FROM (SELECT parent AS node FROM e UNION SELECT child FROM e)), c AS (SELECT x.node, x.id, coalesce(y.id, 1) AS parent, string_split(x.node, '/')[-1] AS name, x.node IN (SELECT parent FROM e) AS dir FROM i x LEFT JOIN e ON e.child = x.node LEFT JOIN i y ON y.node = e.parent)"


def _url_tables(spark, sf_dir) -> Tables:
    e = saved(_url_edges(spark, sf_dir))
    nodes = e.select(F.col("parent").alias("node"), F.lit(True).alias("dir")).unionByName(e.select(F.col("child").alias("node"), F.lit(False).alias("dir")))
    i = saved(assign_ids(nodes.groupBy("node").agg(F.max("dir").alias("dir")), ["node"], "id", 9))
    above = e.join(i.select(F.col("node").alias("parent"), F.col("id").alias("parent_inode")), "parent").select(F.col("child").alias("node"), "parent_inode")
    entries = i.join(above, "node", "left").select(F.col("id").alias("inode"), F.coalesce("parent_inode", F.lit(ROOT)).cast("long").alias("parent_inode"), F.element_at(F.split("node", "/"), -1).cast("binary").alias("name"))
    names = saved(assign_ids(entries.groupBy("name").agg(F.count("*").alias("refcount")), ["name"], "id", 0)).select("id", "name", "refcount")
    contents = saved(entries.join(names.select(F.col("id").alias("name_id"), "name"), "name").select(F.col("inode").alias("rowid"), "name_id", "inode", "parent_inode"))
    zero = F.lit(0).cast("long")
    inode = lambda i, mode, refs, size: [i.cast("long").alias("id"), *[zero.alias(c) for c in ("uid", "gid")], mode.cast("long").alias("mode"), *[zero.alias(c) for c in ("mtime_ns", "atime_ns", "ctime_ns")], F.lit(refs).cast("long").alias("refcount"), size.cast("long").alias("size"), zero.alias("rdev"), F.lit(False).alias("locked")]
    bytes_ = F.octet_length("node")
    seeds = spark.range(1).select(*inode(F.lit(ROOT), F.lit(DIRECTORY), 1, F.lit(0))).unionByName(spark.range(1).select(*inode(F.lit(CONTROL), F.lit(REGULAR), 42, F.lit(0))))
    inodes = seeds.unionByName(i.select(*inode(F.col("id"), F.when(F.col("dir"), DIRECTORY).otherwise(REGULAR), 1, F.when(F.col("dir"), 0).otherwise(bytes_))))
    files = i.where("not dir")
    objects = files.select("id", F.unhex(F.sha2("node", 256)).alias("hash"), F.lit(1).cast("long").alias("refcount"), bytes_.cast("long").alias("phys_size"), bytes_.cast("long").alias("length"))
    blocks = files.select(F.col("id").alias("inode"), zero.alias("blockno"), F.col("id").alias("obj_id"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    return Tables(objects, saved(inodes), blocks, empty("inode long, target binary"), names, contents, empty("inode long, name_id long, value binary"))


def _paths(t: Tables) -> DataFrame:
    e = t.contents_v().select(F.col("parent_inode").alias("parent"), F.col("inode").alias("child"), scalar.text_of(F.col("name")).alias("name"))
    return tree.paths(e, t.inodes.sparkSession.range(ROOT, ROOT + 1).select(F.col("id").alias("node")))


def _host(t: Tables, newest: bool = False) -> tuple[int, bytes]:
    """The host directory of the smallest or largest inode."""
    row = t.contents_v().where(F.col("parent_inode") == ROOT).orderBy(F.desc("inode") if newest else "inode").select("inode", "name").first()
    return row.inode, bytes(row.name)


_FIRST = "(SELECT node FROM c WHERE parent = 1 ORDER BY id LIMIT 1)"
_LAST = "(SELECT node FROM c WHERE parent = 1 ORDER BY id DESC LIMIT 1)"
_BELOW = "(c.node = {0} OR starts_with(c.node, {0} || '/'))"


@_query(f"WITH {_FS}, s AS (SELECT *, {_BELOW.format(_FIRST)} AS copied FROM c) SELECT count(*) + count(*) FILTER (copied) AS entries, count(*) + count(*) FILTER (copied) + 2 AS inodes, count(*) FILTER (NOT dir) AS objects, sum(CASE WHEN dir THEN 0 ELSE octet_length(encode(node)) * CASE WHEN copied THEN 2 ELSE 1 END END)::BIGINT AS total_size, sum(CASE WHEN dir THEN 0 ELSE octet_length(encode(node)) END)::BIGINT AS dedup_size FROM s AS s")
def subtree_copy(spark, sf_dir):
    t, name_id = tree.interned(_url_tables(spark, sf_dir), b"copy")
    t = tree.copy_subtree(t, _host(t)[0], ROOT, name_id)
    return stats.extended_stats(t).select("entries", "inodes", "objects", "total_size", "dedup_size")


@_query(f"WITH {_FS} SELECT id AS inode FROM c WHERE NOT {_BELOW.format(_FIRST)}")
def subtree_remove(spark, sf_dir):
    t = _url_tables(spark, sf_dir)
    return tree.remove_subtree(t, ROOT, _host(t)[1]).inodes.where("id > 2").select(F.col("id").alias("inode"))


@_query(f"WITH {_FS} SELECT id AS inode, {_BELOW.format(_LAST)} AS locked FROM c")
def subtree_lock(spark, sf_dir):
    t = _url_tables(spark, sf_dir)
    return tree.lock_subtree(t, _host(t, True)[0]).inodes.where("id > 2").select(F.col("id").alias("inode"), "locked")


@_query(f"WITH {_FS}, f AS (SELECT min(id) AS a, max(id) AS b FROM c WHERE parent = 1) SELECT id AS inode, CASE WHEN parent = f.a THEN f.b ELSE parent END AS parent_inode FROM c, f")
def bulk_reparent(spark, sf_dir):
    t = _url_tables(spark, sf_dir)
    return tree.reparent(t.contents, _host(t)[0], _host(t, True)[0]).select("inode", "parent_inode")


@_query(f"WITH {_FS} SELECT id AS node, '/' || node AS path FROM c UNION ALL SELECT 1, ''")
def tree_paths(spark, sf_dir):
    return _paths(_url_tables(spark, sf_dir))


@_query(f"WITH {_FS} SELECT '/' || node AS path, id AS inode FROM c UNION ALL SELECT '/' || node || '/none', NULL FROM c WHERE NOT dir")
def inodes_of(spark, sf_dir):
    t = _url_tables(spark, sf_dir)
    known = saved(_paths(t).where("path <> ''").select("path", "node"))
    files = known.join(t.inodes.where(F.col("mode") == REGULAR).select(F.col("id").alias("node")), "node", "left_semi")
    return tree.inodes_of(t, known.select("path").unionByName(files.select(F.concat("path", F.lit("/none")).alias("path"))))


@_query(f"WITH {_FS} SELECT id AS node, '/' || CASE WHEN {_BELOW.format(_FIRST)} THEN {_LAST} || '/moved' || substr(node, length({_FIRST}) + 1) ELSE node END AS path FROM c UNION ALL SELECT 1, ''")
def rename(spark, sf_dir):
    """The first host becomes the directory `moved` of the last one."""
    t = _url_tables(spark, sf_dir)
    return _paths(tree.rename(t, ROOT, _host(t)[1], _host(t, True)[0], b"moved"))


@_query(f"WITH {_FS}, gone AS (SELECT min(id) AS id FROM c WHERE NOT dir), left_ AS (SELECT c.* FROM c, gone WHERE c.id <> gone.id) SELECT 'inode' AS kind, id::VARCHAR AS key, 1 AS refcount FROM left_ UNION ALL SELECT 'name', name, count(*) FROM left_ GROUP BY name UNION ALL SELECT 'object', id::VARCHAR, 1 FROM left_ WHERE NOT dir")
def unlink(spark, sf_dir):
    """The file of the smallest inode goes, with its object, and its name if no other entry has it."""
    t = _url_tables(spark, sf_dir)
    first = t.inodes.where((F.col("mode") == REGULAR) & (F.col("id") > 2)).agg(F.min("id")).first()[0]
    entry = t.contents_v().where(F.col("inode") == first).select("parent_inode", "name").first()
    t = tree.unlink(t, entry.parent_inode, bytes(entry.name))
    rows = [t.inodes.where("id > 2").select(F.lit("inode").alias("kind"), F.col("id").cast("string").alias("key"), "refcount"), t.names.select(F.lit("name"), scalar.text_of(F.col("name")), "refcount"), t.objects.select(F.lit("object"), F.col("id").cast("string"), "refcount")]
    return rows[0].union(rows[1]).union(rows[2])


@_query(f"WITH {_FS}, f AS (SELECT min(id) AS a FROM c) SELECT a AS inode, 'user.b' AS name, 'two' AS value, 1::BIGINT AS refcount FROM f")
def set_attribute(spark, sf_dir):
    """An attribute set, one set twice, and the first one removed: its name goes with it."""
    t = _url_tables(spark, sf_dir)
    first = t.inodes.where("id > 2").agg(F.min("id")).first()[0]
    t = tree.set_attribute(t, first, b"user.a", b"one")
    t = tree.set_attribute(tree.set_attribute(t, first, b"user.b", b"one"), first, b"user.b", b"two")
    t = tree.remove_attribute(t, first, b"user.a")
    found = t.ext_attributes_v().select("inode", "name_id", scalar.text_of(F.col("name")).alias("name"), scalar.text_of(F.col("value")).alias("value"))
    return found.join(t.names.where(F.col("name").startswith(F.lit(b"user."))).select(F.col("id").alias("name_id"), "refcount"), "name_id", "full").select("inode", "name", "value", "refcount")


# --- checks --------------------------------------------------------------------------------------------------


@_query(
    "WITH i AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_size AS size FROM part) SELECT id, unnest(list_filter(["
    "CASE WHEN k = 0 THEN 'no type' END, CASE WHEN k = 2 AND id % 5 = 0 THEN 'symlink without target' END, CASE WHEN k = 2 AND id % 5 <> 0 AND size <> 7 THEN 'symlink size' END,"
    "CASE WHEN k = 4 AND size <> 0 THEN 'size of special file' END, CASE WHEN k <> 2 AND id % 10 = 1 THEN 'target of non-symlink' END, CASE WHEN id % 9 = 0 AND k <> 5 THEN 'device number' END,"
    "CASE WHEN id % 14 = 1 AND k NOT IN (0, 1) THEN 'children of non-directory' END, CASE WHEN id % 15 = 0 AND k NOT IN (0, 3) THEN 'blocks of non-file' END], lambda x: x IS NOT NULL)) AS rule FROM i"
)
def mode_rules(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    zero, k, i = F.lit(0).cast("long"), F.col("p_partkey") % 6, F.col("p_partkey")
    mode = F.when(k == 1, DIRECTORY).when(k == 2, SYMLINK).when(k == 3, REGULAR).when(k == 4, 0o010000).when(k == 5, 0o060000).otherwise(0)
    inodes = p.select(i.alias("id"), *[zero.alias(c) for c in ("uid", "gid")], mode.cast("long").alias("mode"), *[zero.alias(c) for c in ("mtime_ns", "atime_ns", "ctime_ns")], F.lit(1).cast("long").alias("refcount"), F.when(k == 5, 0).otherwise(F.col("p_size")).cast("long").alias("size"), F.when(i % 9 == 0, 7).otherwise(0).cast("long").alias("rdev"), F.lit(False).alias("locked"))
    links = p.where(((k == 2) & (i % 5 != 0)) | ((k != 2) & (i % 10 == 1))).select(i.alias("inode"), F.lit("seven77").cast("binary").alias("target"))
    contents = p.where(i % 14 == 1).select(i.alias("rowid"), zero.alias("name_id"), (i + 10**7).alias("inode"), i.alias("parent_inode"))
    blocks = p.where(i % 15 == 0).select(i.alias("inode"), zero.alias("blockno"), zero.alias("obj_id"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    t = Tables(empty("id long, hash binary, refcount long, phys_size long, length long"), inodes, blocks, links, empty("id long, name binary, refcount long"), contents, empty("inode long, name_id long, value binary"))
    return checks.detect_conventions(t)


# the control inode (2) is exempt
ORACLE["mode_rules"] += " WHERE id <> 2"


_CHECKED = ["lost+found", "names refcount", "contents name", "contents inode", "contents parent", "null hash", "blocks object", "blocks inode", "objects refcount", "inodes refcount", "sizes", "attribute name", "attribute inode", "symlink inode", "loops", "conventions", "foreign keys", "duplicate keys"]


@_query(
    f"WITH {_FS}, n AS (SELECT count(*) FILTER (NOT dir AND id % 11 = 0) AS objects, count(*) FILTER (NOT dir AND id % 5 = 0) AS sizes, count(*) FILTER (id % 13 = 0) AS attributes, count(*) FILTER (id % 17 = 0) AS links, count(*) FILTER (NOT dir AND id % 19 = 0) AS inodes, count(*) FILTER (NOT dir AND id % 7 = 0) AS types FROM c), names AS (SELECT count(*) AS names FROM (SELECT DISTINCT name, length(name) % 3 AS k FROM c) WHERE k = 0) "
    + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", {v}::BIGINT AS violations, 0::BIGINT AS after_repair FROM n, names" for k, v in zip(_CHECKED, ["0", "names + 1", "0", "0", "0", "links", "0", "0", "objects", "inodes", "sizes", "0", "attributes", "links", "3", "types", "0", "0"]))
)
def full_check(spark, sf_dir):
    """Faults of nine kinds in the file system of page urls: what each check finds, and what is left after all repairs."""
    base = _url_tables(spark, sf_dir)
    t = checks.repair_lost_found(base, None)
    is_file = (F.col("mode") == REGULAR) & (F.col("id") > 2)
    hit = lambda c, cond, value: F.when(cond, value).otherwise(F.col(c)).alias(c)
    changed = {"size": ("size", is_file & (F.col("id") % 5 == 0), F.col("size") - 1), "mode": ("mode", is_file & (F.col("id") % 7 == 0), F.col("mode") - REGULAR), "refcount": ("refcount", is_file & (F.col("id") % 19 == 0), F.lit(5).cast("long"))}
    inodes = t.inodes.select(*[hit(*changed[c]) if c in changed else c for c in t.inodes.columns])
    # two directories that hold each other, and one that holds itself
    loops = [(10**7 + k, DIRECTORY) for k in range(3)]
    inodes = inodes.unionByName(spark.createDataFrame([(i, 0, 0, m, 0, 0, 0, 1, 0, 0, False) for i, m in loops], t.inodes.schema))
    names = t.names.select("id", "name", hit("refcount", F.length(scalar.text_of(F.col("name"))) % 3 == 0, F.col("refcount") + 1))
    names = names.unionByName(spark.createDataFrame([(10**7, b"loop", 3), (10**7 + 1, b"user.x", 0)], t.names.schema))
    contents = t.contents.unionByName(spark.createDataFrame([(10**7, 10**7, 10**7, 10**7 + 1), (10**7 + 1, 10**7, 10**7 + 1, 10**7), (10**7 + 2, 10**7, 10**7 + 2, 10**7 + 2)], t.contents.schema))
    dangling = base.inodes.where("id > 2").select((F.col("id") + 10**9).alias("inode"), F.col("id"))
    attributes = dangling.where("id % 13 = 0").select("inode", F.lit(10**7 + 1).cast("long").alias("name_id"), F.lit(b"v").alias("value"))
    links = dangling.where("id % 17 = 0").select("inode", F.lit(b"to").alias("target"))
    unhashed = dangling.where("id % 17 = 0").select(F.col("inode").alias("id"), F.lit(None).cast("binary").alias("hash"), F.lit(0).cast("long").alias("refcount"), F.lit(-1).cast("long").alias("phys_size"), F.lit(1).cast("long").alias("length"))
    objects = t.objects.select("id", "hash", hit("refcount", F.col("id") % 11 == 0, F.lit(9).cast("long")), "phys_size", "length").unionByName(unhashed)
    t = Tables(objects, inodes, t.inode_blocks, links, names, contents, attributes)
    t = Tables(**{name: saved(df) for name, df in t.items()})
    mended, found = checks.run_checks(t, BLOCK)
    _, again = checks.run_checks(mended, BLOCK, repair=False)
    return spark.createDataFrame([(k, n, again[k]) for k, n in found.items()], "check string, violations long, after_repair long")


# --- scalar functions ----------------------------------------------------------------------------------------


@_query(
    "WITH v AS (SELECT doc_id, length(text) * [1, 1000, 1000000, 1000000000][doc_id % 4 + 1]::BIGINT AS n FROM documents), u AS (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS k FROM v), w AS (SELECT *, n / power(1024, k) AS x FROM u)"
    " SELECT doc_id, n, CASE WHEN k = 0 THEN n || ' bytes' ELSE (CASE WHEN x < 10 THEN printf('%.2f', x) WHEN x < 100 THEN printf('%.1f', x) ELSE floor(x)::BIGINT::VARCHAR END) || ' ' || ['KiB', 'MiB', 'GiB', 'TiB'][k] END AS size FROM w"
)
def size_pretty(spark, sf_dir):
    n = F.length("text").cast("long") * F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 1000, 1000000, 1000000000)]), (F.col("doc_id") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", n.alias("n")).withColumn("size", scalar.pretty_size(F.col("n")))


@_query("SELECT doc_id, 'metadata_' || lpad(lower(printf('%x', doc_id)), 12, '0') || '_' || lpad(lower(printf('%x', doc_id * 7)), 10, '0') AS key, replace(replace(replace(source || '/a=b#' || doc_id, '=', '=3D'), '/', '=2F'), '#', '=23') AS escaped, source || '/a=b#' || doc_id AS plain, doc_id AS blockno, doc_id * 7 AS seq_no FROM documents")
def key_codec(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    plain = F.concat("source", F.lit("/a=b#"), F.col("doc_id").cast("string"))
    d = d.select("doc_id", scalar.metadata_key(F.col("doc_id"), F.col("doc_id") * 7).alias("key"), scalar.escape_key(plain).alias("escaped"))
    block, seq = scalar.parse_metadata_key(F.col("key"))
    return d.select("doc_id", "key", "escaped", scalar.unescape_key(F.col("escaped")).alias("plain"), block.alias("blockno"), seq.alias("seq_no"))


@_query("SELECT page_id, replace(replace(url_encode(url), '%2F', '/'), '~', '%7E') AS quoted, url AS unquoted FROM pages")
def url_codec(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", scalar.url_quote(F.col("url")).alias("quoted"))
    return p.withColumn("unquoted", scalar.url_unquote(F.col("quoted")))


@_query("SELECT doc_id, lang, TRY_CAST(substr(source, 4) AS BIGINT) AS n, true AS same FROM documents")
def literals(spark, sf_dir):
    """A frozen mapping thawed again, and a typed value read from text."""
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    back = scalar.thaw_mapping(scalar.freeze_mapping(m))
    same = F.coalesce(back["source"] == F.col("source"), F.col("source").isNull())
    return _t(spark, sf_dir, "documents").select("doc_id", back["lang"].alias("lang"), scalar.parse_literal(F.expr("substr(source, 4)"), "long").alias("n"), same.alias("same"))


@_query("SELECT doc_id, sha256(text) AS sha256, base64(unhex(md5(text))) AS md5_base64 FROM documents")
def digests(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(scalar.sha256(F.col("text")))).alias("sha256"), scalar.md5_base64(F.col("text")).alias("md5_base64"))


# bounds of four even ranges of 26 letters (0, 6, 13, 19) and of 10 digits (0, 2, 5, 7)
@_query("SELECT doc_id, CASE WHEN c BETWEEN 'a' AND 'f' OR c BETWEEN 'A' AND 'F' OR c BETWEEN '0' AND '1' THEN 0 WHEN c BETWEEN 'g' AND 'm' OR c BETWEEN 'G' AND 'M' OR c BETWEEN '2' AND '4' THEN 1 WHEN c BETWEEN 'n' AND 's' OR c BETWEEN 'N' AND 'S' OR c BETWEEN '5' AND '6' THEN 2 WHEN c BETWEEN 't' AND 'z' OR c BETWEEN 'T' AND 'Z' OR c BETWEEN '7' AND '9' THEN 3 ELSE 4 END AS part FROM (SELECT doc_id, coalesce(text[1], '') AS c FROM documents)")
def char_partition(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", scalar.first_char_part(F.coalesce("text", F.lit("")), 5).alias("part"))


@_query("SELECT doc_id, CASE WHEN length(text) <= 2048 THEN (length(text) + 254) // 255 END AS pieces, CASE WHEN length(text) <= 2048 THEN true END AS same FROM documents")
def header_chunks(spark, sf_dir):
    """Texts over the limit of a header can't be stored: null."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text").withColumn("c", scalar.header_chunks(F.col("text")))
    return d.select("doc_id", F.when(F.col("c").isNotNull(), F.size("c")).cast("long").alias("pieces"), (scalar.join_chunks(F.col("c")) == F.col("text")).alias("same"))


@_query("SELECT o_orderkey, array_to_string(list_append(list_transform(range(1, (length(s) - 1) // 3 + 1), lambda k: left(s, 3 * k)), s), '/') AS path FROM (SELECT o_orderkey, (o_orderkey * 997)::VARCHAR AS s FROM orders)")
def key_path(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", scalar.key_path(F.col("o_orderkey").cast("long") * 997).alias("path"))


@_query("SELECT event_id, ts::TIMESTAMP AS parsed FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def backup_time(spark, sf_dir):
    named = _t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd_HH:mm:ss").alias("name"))
    return named.select("event_id", scalar.backup_time(F.col("name")).cast("timestamp_ntz").alias("parsed"))


@_query("WITH w AS (SELECT doc_id, source AS parent, lang AS name FROM documents WHERE doc_id % 2 = 0), k AS (SELECT DISTINCT source AS parent, lang AS name FROM documents WHERE doc_id % 2 = 1), n AS (SELECT w.*, row_number() OVER (PARTITION BY w.parent, w.name ORDER BY doc_id) - CASE WHEN k.name IS NULL THEN 1 ELSE 0 END AS i FROM w LEFT JOIN k ON k.parent = w.parent AND k.name = w.name) SELECT doc_id, CASE WHEN i = 0 THEN name ELSE name || '-' || i END AS new_name FROM n")
def unique_names(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("parent"), F.col("lang").alias("name"))
    return scalar.unique_names(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1").select("parent", "name").distinct(), order="doc_id").select("doc_id", "new_name")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < o_orderkey % 5 OR o_orderkey % 3 < o_orderkey % 7 THEN 99 ELSE o_orderkey % 3 END AS atime, (o_custkey + 511) // 512 AS st_blocks FROM orders")
def stat_columns(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("size", F.col("o_custkey")).withColumn("refcount", F.lit(1))
    k = F.col("o_orderkey")
    return stats.attribute_columns(o).select("o_orderkey", scalar.touch_atime(k % 3, k % 7, k % 5, F.lit(99).cast("long")).alias("atime"), "st_blocks")


@_query("SELECT doc_id, md5('4:lang=' || length(lang) || ':' || lang || ';6:source=' || length(source) || ':' || source) AS checksum FROM documents")
def mapping_checksum(spark, sf_dir):
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("signature"), F.lit("x"), F.lit("lang"), F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", scalar.mapping_checksum(m).alias("checksum"))


# --- figures and caches --------------------------------------------------------------------------------------


@_query(f"WITH {_B}, o AS (SELECT count(*) AS objects, sum(length)::BIGINT AS size FROM (SELECT hash, max(length) AS length FROM h GROUP BY hash)), n AS (SELECT count(*) AS inodes FROM documents), s AS (SELECT *, greatest(4096, size // objects) AS block_size, greatest(2 * size, 1099511627776) AS total FROM o, n) SELECT block_size, total // block_size AS blocks, (total - size) // block_size AS free_blocks, greatest(2 * inodes, 1000000) AS inode_total, greatest(2 * inodes, 1000000) - inodes AS inodes_free FROM s")
def capacity(spark, sf_dir):
    return stats.capacity(content.object_table(_blocks(spark, sf_dir)), _t(spark, sf_dir, "documents").select("doc_id"))


@_query("SELECT o_orderpriority, count(*) AS entries, sum(round(o_totalprice))::BIGINT AS bytes, count(*) FILTER (o_orderstatus = 'O') AS dirty_entries, coalesce(sum(round(o_totalprice)) FILTER (o_orderstatus = 'O'), 0)::BIGINT AS dirty_bytes FROM orders GROUP BY 1")
def cache_usage(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("n", F.round("o_totalprice").cast("long"))
    return stats.cache_usage(o, "n", F.col("o_orderstatus") == "O", ["o_orderpriority"])


@_query(f"WITH {_FS} SELECT count(*) AS entries, count(*) FILTER (NOT dir) AS objects, count(*) + 2 AS inodes, sum(CASE WHEN dir THEN 0 ELSE octet_length(encode(node)) END)::BIGINT AS fs_size, sum(CASE WHEN dir THEN 0 ELSE octet_length(encode(node)) END)::BIGINT AS dedup_size, sum(CASE WHEN dir THEN 0 ELSE octet_length(encode(node)) END)::BIGINT AS compr_size, 4096::BIGINT AS db_size, (SELECT count(*) FROM orders) AS cache_entries, (SELECT 10 * count(*) FROM orders) AS cache_size, (SELECT count(*) FILTER (o_orderstatus = 'O') FROM orders) AS cache_dirty_entries, (SELECT 10 * count(*) FILTER (o_orderstatus = 'O') FROM orders) AS cache_dirty_size, 7::BIGINT AS removals FROM c")
def stats_record(spark, sf_dir):
    cache = _t(spark, sf_dir, "orders").select(F.lit(10).cast("long").alias("bytes"), (F.col("o_orderstatus") == "O").alias("dirty"))
    return stats.stats_record(_url_tables(spark, sf_dir), cache, 4096, 7)


@_query()
def lru_cache(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.lit(1024).cast("long").alias("bytes"))
    return content.lru_cache(e, 100 * 1024, 50)


# --- stores and streams --------------------------------------------------------------------------------------


@_query("SELECT doc_id, 'metadata_' || lpad(printf('%x', doc_id % 64), 12, '0') || '_' || lpad(printf('%x', doc_id // 64), 10, '0') AS key, doc_id % 64 AS blockno, doc_id // 64 AS seq_no FROM documents WHERE doc_id % 3 <> 0")
def metadata_listing(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", scalar.metadata_key(F.col("doc_id") % 64, F.expr("doc_id div 64")).alias("key"))
    listing = d.where("doc_id % 3 <> 0").unionByName(d.where("doc_id % 3 = 0").withColumn("key", F.concat("key", F.lit("_bak_0"))))
    found = store.metadata_versions(listing)
    return found.select((F.col("seq_no") * 64 + F.col("blockno")).alias("doc_id"), scalar.metadata_key(F.col("blockno"), F.col("seq_no")).alias("key"), "blockno", "seq_no")


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n FROM events GROUP BY 1, 2 HAVING \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_rates(spark, sf_dir):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = flows.event_stream(spark, f"{sf_dir}/events.parquet")
    # one batch moves the watermark, the next one closes the windows before it
    flows.append(flows.rates(events, "ts", "1 day", "1 day", "1 hour"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema("start timestamp, end timestamp, n long").parquet(f"{folder}/out")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
