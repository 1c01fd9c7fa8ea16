"""Language identification by prediction by partial matching (PPM).

For every language of the labelled sample a variable-order context tree over bytes is counted: contexts of 0 to ORDER
bytes, each with the bytes that followed. With t followers of d different kinds, a context gives a byte it has seen c
times the probability c / (t + d) and escapes to the next shorter context with d / (t + d); below order 0 all 256
bytes are alike. The statistics are then frozen, and a text's code length under a language is the exact sum over its
bytes. The language of the shortest code is predicted; the score is its share of 2 ** -length over all languages.

As the statistics are frozen, a byte's code length depends on its last ORDER bytes only: the trees of all languages
become one table per order from (context, byte) to code lengths, found by a hash lookup for whole batches at a time.

Letters are lower-cased and other ASCII characters read as spaces. The trees are learnt from a bounded sample, up to
DOCS_PER_LANGUAGE whole documents of each language in the order of a hash of doc_id; texts are scored whole and
without a shuffle. Null texts and texts without a letter are `und` with score 0; so is all if nothing can be learnt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.shared import by_bytes, mix, text_bytes

ORDER = 4
DOCS_PER_LANGUAGE = 300

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128] = 32
_CLEAN[97:123] = np.arange(97, 123)
_LETTER = re.compile(r"[^\W\d_]")


class Table:
    """Sorted 64-bit keys with a hash directory: `find` gives positions, or -1."""

    def __init__(self, keys: np.ndarray) -> None:
        h = mix(keys)
        self.order = np.argsort(h)
        self.keys = keys[self.order]
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        slot = (h[self.order] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of `keys` in the order they were given to the constructor, or -1."""
        slot = (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        for _ in range(self.most):
            if not len(left):
                break
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = self.order[here[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def cleaned(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, each after ORDER spaces, and where each row's own bytes start and end."""
    data, at = text_bytes(pc.utf8_lower(texts.fill_null("")))
    n = len(at) - 1
    out = np.full(len(data) + ORDER * n, 32, np.uint8)
    size = np.diff(at)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, n + 1), size)] = _CLEAN[data]
    start = at[:-1] + ORDER * np.arange(1, n + 1)
    return out, np.stack([start, start + size])


def grams(data: np.ndarray, positions: np.ndarray, order: int) -> np.ndarray:
    """The byte at each position after its `order` bytes before it, as one number."""
    key = np.zeros(len(positions), np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | data[positions - back]
    return key


class Trees:
    """Frozen context trees of several languages as lookup tables of code lengths in bits."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.names = sorted(samples)
        n = len(self.names)
        counted: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for name in self.names:
            data, spans = cleaned(pa.array(samples[name], pa.string()))
            positions = _inside(spans)
            for order in range(ORDER + 1):
                counted[order].append(np.unique(grams(data, positions, order), return_counts=True))
        self.tables: list[Table] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[Table] = []
        self.escapes: list[np.ndarray] = []
        below = np.full((256, n), 8.0)
        for order in range(ORDER + 1):
            keys = np.unique(np.concatenate([k for k, _ in counted[order]])) if n else np.zeros(0, np.uint64)
            context = np.unique(keys >> np.uint64(8))
            escape, bits = np.zeros((len(context), n)), np.full((len(keys), n), np.nan)
            for i, (k, c) in enumerate(counted[order]):
                own, at, kinds = np.unique(k >> np.uint64(8), return_inverse=True, return_counts=True)
                total = np.bincount(at, weights=c, minlength=len(own))
                escape[np.searchsorted(context, own), i] = -np.log2(kinds / (total + kinds))
                bits[np.searchsorted(keys, k), i] = -np.log2(c / (total + kinds)[at])
            if order:
                shorter = below[np.searchsorted(last, keys & np.uint64((1 << 8 * order) - 1))]
            else:
                shorter = below[keys.astype(np.int64)]
            longer = escape[np.searchsorted(context, keys >> np.uint64(8))] + shorter
            bits = np.where(np.isnan(bits), longer, bits)
            self.tables.append(Table(keys))
            self.contexts.append(Table(context))
            self.bits.append(bits.astype(np.float32))
            self.escapes.append(escape.astype(np.float32))
            below, last = bits, keys

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code length in bits of each text (row) under each language (column)."""
        data, spans = cleaned(texts)
        positions = _inside(spans)
        cost = np.zeros((len(positions), len(self.names)), np.float32)
        left = np.arange(len(positions))
        for order in range(ORDER, -1, -1):
            key = grams(data, positions[left] if order < ORDER else positions, order)
            row = self.tables[order].find(key)
            hit = row >= 0
            if order == ORDER:
                cost[hit] = self.bits[order][row[hit]]
            else:
                cost[left[hit]] += self.bits[order][row[hit]]
            left, missed = left[~hit], key[~hit]
            if not len(left):
                break
            known = self.contexts[order].find(missed >> np.uint64(8))
            some = known >= 0
            cost[left[some]] += self.escapes[order][known[some]]
        if len(left):
            cost[left] += 8
        total = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(cost, axis=0, dtype=np.float64)])
        size = spans[1] - spans[0]
        end = np.cumsum(size)
        return total[end] - total[end - size]


def _inside(spans: np.ndarray) -> np.ndarray:
    size = spans[1] - spans[0]
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(spans[0] - before, size)


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Trees:
    """Trees of a bounded sample of the rows with text, lang and doc_id outside the held-out third."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return Trees({})
    rank, span = F.xxhash64("doc_id"), 2**20
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(span * min(1.0, 1.3 * docs_per_language / r["count"])) + 1))])
    some = rows.where(F.pmod(rank, F.lit(span)) < share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(F.pmod(rank, F.lit(span)), rank, "text")
    sample: dict[str, list[str]] = {}
    for r in some.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= docs_per_language).collect():
        sample.setdefault(r.lang, []).append(r.text)
    return Trees({k: sorted(v) for k, v in sample.items()})


def held_out(doc_id):
    """Whether crc32(doc_id as text) mod 3 is 1; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _predict(trees: Trees):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 19):
            texts = batch.column("text")
            data, at = text_bytes(texts)
            ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
            has = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
            for i in np.flatnonzero(~has & (at[1:] > at[:-1])).tolist():
                has[i] = _LETTER.search(texts[i].as_py()) is not None
            if not trees.names:
                has[:] = False
                best, score = np.zeros(len(has), int), np.zeros(len(has))
            else:
                bits = trees.lengths(texts)
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
            names = np.array([*trees.names, "und"], object)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[np.where(has, best, len(trees.names))], pa.string()), pa.array(np.where(has, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    trees = learn(docs) if trees is None else trees
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_predict(trees), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
