"""Functions over columns, built-in expressions that stay inside code generation, and names and numbers over rows."""

from __future__ import annotations

import bisect
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.operators.storage import saved


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("binary"), 256))


def md5_base64(c: Column) -> Column:
    return F.base64(F.unhex(F.md5(c.cast("binary"))))


def hex_padded(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def parse_hex(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("long")


def metadata_key(blockno: Column, seq_no: Column, prefix: str = "metadata_") -> Column:
    """Key of a versioned metadata block: 12 and 10 hex digits."""
    return F.concat(F.lit(prefix), hex_padded(blockno, 12), F.lit("_"), hex_padded(seq_no, 10))


def parse_metadata_key(key: Column, prefix: str = "metadata_") -> tuple[Column, Column]:
    """blockno and seq_no of a key; null for any other name."""
    pattern = f"^{prefix}([0-9a-f]+)_([0-9a-f]+)$"
    part = lambda k: F.when(key.rlike(pattern), parse_hex(F.regexp_extract(key, pattern, k)))
    return part(1), part(2)


def escape_key(c: Column) -> Column:
    """= / # as =3D =2F =23; = comes first, or it would escape the others' marks."""
    for a, b in (("=", "=3D"), ("/", "=2F"), ("#", "=23")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_key(c: Column) -> Column:
    for a, b in (("#", "=23"), ("/", "=2F"), ("=", "=3D")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def escape_path(c: Column) -> Column:
    """A path without its first character as one name: _ doubled, / as _."""
    return F.replace(F.replace(F.substring(c, F.lit(2), F.length(c)), F.lit("_"), F.lit("__")), F.lit("/"), F.lit("_"))


def text_of(c: Column) -> Column:
    """Bytes as text, with the replacement character for what is not UTF-8."""
    return F.make_valid_utf8(c.cast("string"))


def pretty_size(n: Column) -> Column:
    """bytes, KiB, MiB, GiB, TiB: two decimals below 10, one below 100, whole below that; whole numbers are cut off."""
    out = None
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        v = n / F.lit(float(1024**k))
        shown = F.when(v < 10, F.format_string("%.2f", F.bround(v, 2))).when(v < 100, F.format_string("%.1f", F.bround(v, 1))).otherwise(F.floor(v).cast("string"))
        cond = F.lit(True) if k == 4 else n < F.lit(1024 ** (k + 1))
        piece = F.concat(shown, F.lit(" " + unit))
        out = F.when((n >= 1024) & cond, piece) if out is None else out.when(cond, piece)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(out)


def key_path(n: Column, digits: int = 3) -> Column:
    """Directory path of an object number: below each other its first 3, 6, 9 ... digits, then the number itself."""
    s = n.cast("string")
    levels = F.floor((F.length(s) - 1) / digits).cast("int")
    above = F.transform(F.sequence(F.lit(1), levels), lambda k: F.substring(s, F.lit(1), k * digits))
    return F.when(levels > 0, F.concat(F.array_join(above, "/"), F.lit("/"), s)).otherwise(s)


def split_every(c: Column, size: int) -> Column:
    """Pieces of `size` characters; the empty string has none."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.length(c) / size).cast("int") - 1), lambda k: F.substring(c, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def header_chunks(c: Column, piece: int = 255, most: int = 2048) -> Column:
    """Metadata text as header pieces; null where it is too long to be stored."""
    return F.when(F.length(c) <= most, split_every(c, piece))


def join_chunks(c: Column) -> Column:
    return F.array_join(c, "")


def freeze_mapping(c: Column) -> Column:
    """A map as canonical JSON, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def thaw_mapping(c: Column, values: str = "string") -> Column:
    """The map of a frozen mapping; null for what is none."""
    return F.from_json(c, f"map<string,{values}>")


def parse_literal(c: Column, kind: str) -> Column:
    """A value of a simple type (long, double, boolean, date ...) from text; null where it is not written as one."""
    return F.trim(c).try_cast(kind)


def serialize_record(*columns: str) -> Column:
    """Columns of a row as one JSON text, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def mapping_checksum(c: Column) -> Column:
    """MD5 of a map's entries in key order, without its signature."""
    entries = F.array_sort(F.map_entries(F.map_filter(c, lambda k, _: k != "signature")))
    return F.md5(F.array_join(F.transform(entries, lambda e: F.concat(F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lit("="), F.length(e["value"]).cast("string"), F.lit(":"), e["value"])), ";").cast("binary"))


def backup_time(c: Column) -> Column:
    return F.to_timestamp(c, "yyyy-MM-dd_HH:mm:ss")


def url_quote(c: Column) -> Column:
    """Percent encoding with %20 for spaces and / left as it is."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def url_unquote(c: Column) -> Column:
    """What `url_quote` made of a text back again; a plus sign is itself."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def touch_atime(atime: Column, mtime: Column, ctime: Column, now: Column) -> Column:
    """Access time after a read: it moves only when older than a change."""
    return F.when((atime < ctime) | (atime < mtime), now).otherwise(atime)


def first_char_part(c: Column, parts: int) -> Column:
    """Part of a name by its first character: a-z, A-Z and 0-9 each in `parts` - 1 even ranges, all else in the last."""
    pools = [string.ascii_lowercase, string.ascii_uppercase, string.digits]
    bounds = [[int(i * (len(pool) / (parts - 1))) for i in range(parts)] for pool in pools]
    part = [parts - 1, *(bisect.bisect_right(b, k) - 1 for pool, b in zip(pools, bounds) for k in range(len(pool)))]
    at = F.when(F.length(c) > 0, F.instr(F.lit("".join(pools)), F.substring(c, F.lit(1), F.lit(1)))).otherwise(0)
    return F.element_at(F.array(*map(F.lit, part)), at + 1)


def number_list(df: DataFrame, partition: list[str], column: str) -> DataFrame:
    """Runs of numbers as text: 1-3, 5 and 7; a run of two is listed as two numbers."""
    w = Window.partitionBy(*partition).orderBy(column)
    runs = df.select(*partition, column).distinct().withColumn("_run", F.col(column) - F.row_number().over(w))
    runs = runs.groupBy(*partition, "_run").agg(F.min(column).alias("a"), F.max(column).alias("b"))
    parts = F.when(F.col("b") - F.col("a") > 1, F.array(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))).when(F.col("b") > F.col("a"), F.array(F.col("a").cast("string"), F.col("b").cast("string"))).otherwise(F.array(F.col("a").cast("string")))
    lists = runs.select(*partition, "a", parts.alias("p")).groupBy(*partition).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "p"))), lambda x: x["p"])).alias("p"))
    text = F.when(F.size("p") > 1, F.concat(F.array_join(F.expr("slice(p, 1, size(p) - 1)"), ", "), F.lit(" and "), F.element_at("p", -1))).otherwise(F.element_at("p", 1))
    return lists.select(*partition, text.alias("numbers"))


def unique_names(wanted: DataFrame, taken: DataFrame, key: str = "parent", name: str = "name", order: str = "id") -> DataFrame:
    """`new_name` for each wanted name: shortened in the middle above 251 bytes, then the first free one of name, name-1, ...

    The k-th of several equal names takes the k-th free number: one window over its wanted rows and the numbers that are
    taken. Where two names lead to the same one (`a` twice and `a-1`), the first row in `order` has it and the others look
    again, until every (key, name) is there once.
    """
    raw = F.col(name).cast("binary")
    short = F.when(F.octet_length(raw) > 251, F.concat(F.substring(raw, F.lit(1), F.lit(120)), F.lit(" ... ").cast("binary"), F.substring(raw, F.octet_length(raw) - 119, F.lit(120)))).otherwise(raw)
    waiting = saved(wanted.withColumn("_base", short.cast("string")))
    names = saved(taken.select(F.col(key), F.col(name).cast("string").alias("_t")).distinct())
    done = None
    while not waiting.isEmpty():
        stem, number = (F.regexp_extract("_t", r"(?s)^(.*)-([1-9][0-9]{0,17})$", k) for k in (1, 2))
        numbers = names.select(key, F.col("_t").alias("_base"), F.lit(0).cast("long").alias("_n")).unionByName(names.where(number != "").select(key, stem.alias("_base"), number.cast("long").alias("_n")))
        numbers = numbers.join(waiting.select(key, "_base").distinct(), [key, "_base"], "left_semi").distinct()
        here = Window.partitionBy(key, "_base")
        free_before = numbers.select(key, "_base", (F.col("_n") - F.row_number().over(here.orderBy("_n")) + 1).alias("_at"), F.lit(0).alias("_kind"))
        asked = waiting.withColumn("_at", (F.row_number().over(here.orderBy(order)) - 1).cast("long")).withColumn("_kind", F.lit(1))
        both = asked.unionByName(free_before, allowMissingColumns=True)
        passed = F.sum(1 - F.col("_kind")).over(here.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        chosen = both.withColumn("_n", F.col("_at") + passed).where("_kind = 1")
        chosen = chosen.withColumn("new_name", F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string"))))
        chosen = saved(chosen.withColumn("_turn", F.row_number().over(Window.partitionBy(key, "new_name").orderBy(order))))
        first = chosen.where("_turn = 1")
        done = first if done is None else done.unionByName(first)
        waiting = chosen.where("_turn > 1").select(*waiting.columns)
        names = names.unionByName(first.select(key, F.col("new_name").alias("_t")))
    if done is None:
        done = waiting.withColumn("new_name", F.col("_base"))
    return done.select(*wanted.columns, "new_name")
