"""Quality rules: base figures of each text and cross-document line frequency.

Lines are normalised (A-Z as a-z, white space as one space) and hashed. For every host (column `source`) the distinct
documents that hold a line are counted; copies, equal texts of one host, are one document, or a group of copies would
condemn itself. A line in more than LINE_DOCS documents and more than LINE_SHARE of its host's documents is removed. A
document that loses more than DEPLETED of its words by this is rejected, and so is one that fails the base rules; of a
kept document the other lines stay, in order and as they were (`keep_good`).

Counting is one aggregation over (host, line) with map-side combining; the frequent lines are joined back, never
broadcast or collected, as their number grows with the corpus. A line that a third of a host's documents share is one
key of the join, which adaptive execution splits.

Null and empty texts have no words and fail. A null host counts as a host of its own. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import by_bytes, mix, text_bytes, written
from granary.llm.shingles import LOWER, span_hash, words

MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
LINE_DOCS = 10
LINE_SHARE = 0.08
DEPLETED = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STEP = mix(np.arange(901, 901 + WINDOW, dtype=np.uint64)) | np.uint64(1)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _lines(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every line with words: first and last word (exclusive), row, begin, stop, and the hash of its words in order.

    start, end and row are those of the words.
    """
    # lines: every row's bytes between line ends
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([at[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)] if len(data) else line_start[:0]
    # a line start after a row's last line end belongs to the next row or to an empty line; only lines with words matter
    line_of = np.searchsorted(line_start, start, "right") - 1
    used, first = np.unique(line_of, return_index=True)
    last = np.append(first[1:], len(start))
    line_row = row[first] if len(first) else np.zeros(0, np.int64)
    begin = line_start[used] if len(used) else np.zeros(0, np.int64)
    following = np.append(line_start, len(data))
    stop = following[used + 1] if len(used) else begin
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10)) if len(used) else stop
    # the words of a line, in order, make its normalised hash
    low = span_hash(LOWER[data], start, end) if len(start) else np.zeros(0, np.uint64)
    within = np.arange(len(start)) - np.repeat(first, last - first) if len(first) else np.zeros(0, np.int64)
    norm = np.add.reduceat(low * (mix(within.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), first) if len(first) else np.zeros(0, np.uint64)
    return first, last, line_row, begin, stop, mix(norm)


def figures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Base figures of each row, and its normalised lines: hash, words in them, and the row's first line."""
    n = len(at) - 1
    start, end, row, exact = words(data, at, lower=False)
    point = (data & 0xC0) != 0x80
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(point, out=points[1:])
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": np.bincount(row, weights=points[end] - points[start], minlength=n).astype(np.int64), "n_symbols": _sums(_SYMBOL[data], at)}
    # windows of eight words that the text has twice or more
    covered = np.zeros(len(row), bool)
    if len(row) >= WINDOW:
        m = len(row) - WINDOW + 1
        total = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            total += exact[k : m + k] * _STEP[k]
        whole = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
        key = mix(total[whole]) ^ mix(row[whole].astype(np.uint64) + np.uint64(7))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(row) + 1, np.int64)
        np.add.at(step, whole[twice], 1)
        np.add.at(step, whole[twice] + WINDOW, -1)
        covered = np.cumsum(step[:-1]) > 0
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    first, last, line_row, begin, stop, norm = _lines(data, at, start, end, row)
    raw = span_hash(data, begin, stop) if len(first) else np.zeros(0, np.uint64)
    key = raw ^ mix(line_row.astype(np.uint64) + np.uint64(11))
    _, one = np.unique(key, return_index=True)
    dup = np.ones(len(key), bool)
    dup[one] = False
    out["n_dup_lines"] = np.bincount(line_row[dup], minlength=n)
    order = np.lexsort((norm, line_row))
    r, h, w = line_row[order], norm[order], (last - first)[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    out["line_hash"] = h[new].view(np.int64)
    out["line_words"] = np.add.reduceat(w, np.flatnonzero(new)) if len(r) else np.zeros(0, np.int64)
    out["line_at"] = np.searchsorted(r[new], np.arange(n + 1))
    return out


_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        data, at = text_bytes(batch.column("text"))
        f = figures(data, at)
        lists = [pa.ListArray.from_arrays(pa.array(f["line_at"], pa.int32()), pa.array(f[c], pa.int64())) for c in ("line_hash", "line_words")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(f[c], pa.int64()) for c in _FIGURES), batch.column("text_key"), *lists], ["doc_id", "host", *_FIGURES, "text_key", "line_hash", "line_words"])


def _text_key(host: Column, text: Column) -> Column:
    """16 bytes that equal texts of one host share."""
    host = F.coalesce(F.concat(F.lit("\2"), host, F.lit("\0")), F.lit("\1"))
    return F.substring(F.unhex(F.sha2(F.concat(host, F.coalesce(text, F.lit(""))), 256)), 1, 16)


def _scored(docs: DataFrame) -> DataFrame:
    """What `score` returns, with text_key and gone: the line hashes that the text loses, null for none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", _text_key(F.col("host"), F.col("text")))
    base = written(rows.mapInArrow(_base, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _FIGURES) + ", text_key binary, line_hash array<long>, line_words array<long>"))
    texts = base.groupBy("text_key").agg(F.first("host").alias("host"), F.first("line_hash").alias("line_hash"), F.first("line_words").alias("line_words"))
    lines = texts.select("text_key", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("text_key", "host", F.col("l.line_hash").alias("hash"), F.col("l.line_words").alias("n"), F.xxhash64(F.coalesce("host", F.lit("\0")), "l.line_hash").alias("line"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = lines.groupBy("line").agg(F.count("*").alias("docs"), F.first("host").alias("host")).where(F.col("docs") > LINE_DOCS)
    # written, so that adaptive execution can split a line that very many documents share
    frequent = written(counts.join(hosts, counts.host.eqNullSafe(hosts.host)).where(F.col("docs") > F.col("host_docs") * LINE_SHARE).select("line"))
    removed = lines.join(frequent.hint("merge"), "line").groupBy("text_key").agg(F.sum("n").alias("removed_words"), F.collect_set("hash").alias("gone"))
    out = base.select("doc_id", *_FIGURES, "text_key").join(removed, "text_key", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.select("doc_id", *_FIGURES, "removed_words", failed.alias("base_failed"), (~failed & (F.col("removed_words") <= DEPLETED * F.col("n_words"))).alias("kept"), "text_key", "gone")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the five base figures, removed_words, base_failed, kept."""
    return _scored(docs).drop("text_key", "gone")


def without(texts: list[str], gone: list[list[int]]) -> list[str]:
    """Each text without the lines whose hashes its list has; the other lines stay as they were."""
    data, at = text_bytes(pa.array(texts, pa.string()))
    start, end, row, _ = words(data, at, lower=False)
    _, _, line_row, begin, _, norm = _lines(data, at, start, end, row)
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, at[line_row])
    cut = np.searchsorted(line_row, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        mine = slice(cut[i], cut[i + 1])
        drop = set(number[mine][np.isin(norm[mine].view(np.int64), np.array(gone[i], np.int64))].tolist())
        out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop))
    return out


def _clean(text: str, names: list[str]):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            gone = batch.column("gone").to_pylist()
            if rows := [i for i, g in enumerate(gone) if g]:
                texts = batch.column(text).to_pylist()
                for i, x in zip(rows, without([texts[i] for i in rows], [gone[i] for i in rows])):
                    texts[i] = x
            cols = [pa.array(texts, pa.string()) if rows and c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return clean


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, their texts without the lines above the limits, other columns as they were."""
    kept = _scored(docs).where("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key")).agg(F.first("gone").alias("gone"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    doc_id, host, text = (names[docs.columns.index(c)] for c in ("doc_id", "source", "text"))
    rows = docs.toDF(*names)
    keyed = rows.withColumn("_key", _text_key(F.col(host).cast("string"), F.col(text)))
    found = keyed.join(kept, F.col(doc_id).eqNullSafe(F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key"))).select(*names, "gone")
    return found.mapInArrow(_clean(text, names), rows.schema).toDF(*docs.columns)
