"""The stored form of objects: compression, keyed digests, encryption, and reading back with every check.

A stored object is a row (key, format_version, compression, nonce, size, signature, payload). Compression and keyed
digests have no built-in form and run as Arrow batches; encryption is Spark's AES-GCM, which authenticates what it
encrypts, with the object key as associated data, so that a stored object can't be passed off as another one.
"""

from __future__ import annotations

import bz2
import hashlib
import hmac
import lzma
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FORMAT_VERSION = 2
ALGORITHMS = ("none", "zlib", "bzip2", "lzma")


def compress_bytes(data: bytes, algorithm: str, level: int = 6) -> bytes:
    if algorithm == "zlib":
        return zlib.compress(data, level)
    if algorithm == "bzip2":
        return bz2.compress(data, max(1, level))
    if algorithm == "lzma":
        return lzma.compress(data, lzma.FORMAT_ALONE, preset=level)
    if algorithm == "none":
        return data
    raise ValueError(algorithm)


def decompress_bytes(data: bytes, algorithm: str) -> tuple[bytes | None, str | None]:
    """Data and no error, or no data and what is wrong."""
    if algorithm == "none":
        return data, None
    if algorithm not in ALGORITHMS:
        return None, "unknown compression"
    try:
        d = zlib.decompressobj() if algorithm == "zlib" else bz2.BZ2Decompressor() if algorithm == "bzip2" else lzma.LZMADecompressor(lzma.FORMAT_ALONE)
        out = d.decompress(data)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return None, "corrupted"
    if not d.eof:
        return None, "premature end"
    return (None, "trailing data") if d.unused_data else (out, None)


def parts_of(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Start and length of runs of values with about `most` bytes each (a longer value comes alone).

    Only what is made of one run is held beside a batch, however many rows Spark puts into it.
    """
    start = size = 0
    for k, n in enumerate(pa.compute.binary_length(column).to_pylist()):
        if k > start and size + (n or 0) > most:
            yield start, k - start
            start, size = k, 0
        size += n or 0
    if start < len(column):
        yield start, len(column) - start


def _each(function, kind: pa.DataType):
    """An Arrow function of one binary column that applies `function` to each value; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            if not len(column):
                yield pa.array([], kind)
            for start, n in parts_of(column):
                yield pa.array((None if b is None else function(b) for b in _values(column, start, n)), kind)

    return run


def _values(column: pa.Array, start: int, n: int) -> Iterator[object]:
    return (column[k].as_py() for k in range(start, start + n))


def compress(data: Column, algorithm: str, level: int = 6) -> Column:
    @arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _each(lambda b: compress_bytes(b, algorithm, level), pa.binary())(parts)

    return run(data)


def decompress(data: Column, algorithm: Column) -> Column:
    """struct(data, error); never fails for a row."""
    kind = pa.struct([("data", pa.binary()), ("error", pa.string())])

    @arrow_udf("data binary, error string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for s, a in batches:
            if not len(s):
                yield pa.array([], kind)
            for start, n in parts_of(s):
                rows = ((None, "missing") if b is None else decompress_bytes(b, k) for b, k in zip(_values(s, start, n), _values(a, start, n)))
                yield pa.array(({"data": d, "error": e} for d, e in rows), kind)

    return run(data, algorithm)


def keyed_digest(key: bytes, data: Column) -> Column:
    """HMAC-SHA256 in hex; a function, as an expression of `sha2` would show the key in plans and event logs."""

    @arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _each(lambda b: hmac.new(key, b, hashlib.sha256).hexdigest(), pa.string())(parts)

    return run(data.cast("binary"))


def _object_key(passphrase: str, nonce: Column) -> Column:
    """The key of an object. A function and not an expression, so that plans and event logs don't show the passphrase."""

    @arrow_udf("binary")
    def derive(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _each(lambda n: hashlib.sha256(passphrase.encode() + n).digest(), pa.binary())(parts)

    return derive(nonce)


def _signed(c: str = "") -> Column:
    return F.concat_ws("\1", *[F.col(x).cast("string") for x in ("key", "format_version", "compression", "size")], F.hex("nonce"), F.hex("payload"))


def encode_objects(objects: DataFrame, algorithm: str = "lzma", level: int = 6, passphrase: str | None = None) -> DataFrame:
    """Stored form of rows (key, data)."""
    nonce = F.unhex(F.sha2(F.concat(F.col("key"), F.lit("nonce"), F.uuid()), 256)) if passphrase else F.lit(None).cast("binary")
    out = objects.select("key", F.lit(FORMAT_VERSION).alias("format_version"), F.lit(algorithm).alias("compression"), nonce.alias("nonce"), F.length(F.col("data").cast("binary")).cast("long").alias("size"), compress(F.col("data").cast("binary"), algorithm, level).alias("payload"))
    if passphrase is None:
        return out.withColumn("signature", F.lit(None).cast("string"))
    sealed = F.expr("aes_encrypt(payload, _k, 'GCM', 'DEFAULT', unhex(''), cast(key as binary))")
    out = out.withColumn("_k", _object_key(passphrase, F.col("nonce"))).withColumn("payload", sealed).drop("_k")
    return out.withColumn("signature", keyed_digest(passphrase.encode(), _signed()))


def decode_objects(stored: DataFrame, passphrase: str | None = None) -> DataFrame:
    """key, data, error: the objects, or why one is refused."""
    error = F.when(~F.col("format_version").eqNullSafe(F.lit(FORMAT_VERSION)), "format version").when(F.col("compression").isNull() | F.col("size").isNull() | F.col("payload").isNull(), "missing metadata")
    if passphrase is None:
        error = error.when(F.col("nonce").isNotNull() | F.col("signature").isNotNull(), "encrypted")
        plain = F.col("payload")
    else:
        error = error.when(F.col("nonce").isNull(), "not encrypted").when(~F.col("signature").eqNullSafe(keyed_digest(passphrase.encode(), _signed())), "signature")
        plain = F.expr("try_aes_decrypt(payload, _k, 'GCM', 'DEFAULT', cast(key as binary))")
        stored = stored.withColumn("_k", _object_key(passphrase, F.col("nonce")))
    checked = stored.withColumn("_e", error).withColumn("_p", F.when(F.col("_e").isNull(), plain)).withColumn("_d", decompress(F.col("_p"), F.col("compression")))
    found = F.coalesce("_e", F.when(F.col("_p").isNull(), "authentication"), "_d.error", F.when(F.length("_d.data") != F.col("size"), "size"))
    return checked.select("key", F.when(found.isNull(), F.col("_d.data")).alias("data"), found.alias("error"))
