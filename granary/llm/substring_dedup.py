"""Suffix-array dedup with a run-length index.

Every byte that a LENGTH-byte string covers which also starts elsewhere is removed; strings are judged on the input.

1. Anchors bring equal strings together. A window of LENGTH bytes has LENGTH - ANCHOR + 1 runs of ANCHOR bytes; the one
   of smallest hash is its anchor, so equal windows have equal anchors at equal places. About one byte in a hundred
   starts an anchor; a stretch of close places of one anchor (periodic text) is one entry. Anchors that occur once are
   dropped; around the others, the bytes that windows with this anchor can cover are the segments to compare. Equal
   texts count once here (their classes are removed whole), and so do equal segments of one anchor (repeated whole).
2. The distinct segments of an anchor are indexed. Their suffixes are sorted by prefix doubling, many anchors at a time
   and each for itself; the Burrows-Wheeler transform is cut into runs, and only suffixes at run ends are sampled.
   Matching statistics stream from these: at a sampled suffix the longest match with its neighbour is measured, and
   from there along the text it falls by one per byte, as suffixes inside a run keep their neighbours. Where it is LENGTH
   or more, the match is marked. A repetitive corpus has few runs.
3. An anchor with more than HOT distinct segments is not gathered in one task. Its windows start 0 to LENGTH - ANCHOR
   bytes before it; the nearer half of them all hold the bytes that follow it, the farther half those that precede it. So
   each segment is cut into these two slices, and slices are dealt by the bytes that all their windows hold: equal
   windows meet again, in parts that are indexed in the same way, and split again where they are still hot. A part of a
   single window start holds equal windows only, so the splitting ends.

Beside the bytes, documents that hold a passage of PASSAGE words (over fifty) which another document holds too are found
in the same way, whatever its length in bytes and the white space between its words: a window of PASSAGE words has as
anchor the run of RUN words of smallest hash, and windows around anchors that several texts have are compared. Such a
passage of under LENGTH bytes is counted (n_shared_passages), not removed.

Marks return to their texts by joins; a text meets its own marks only. Hashes have 64 bits and decide equal segments
and parts; bytes decide step 2. Null is empty. Texts under LENGTH bytes lose nothing, a repeated row is a repeat, an empty
table gives no rows, and other columns are ignored. A very long text is scanned alone; its segments are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import by_bytes, drop_written, mix, runs_of, text_bytes, written
from granary.llm.shingles import BASE, BASE_INVERSE, BYTE_VALUE, _power, words

LENGTH = 400
ANCHOR = 192
PASSAGE = 51
RUN = 18
HOT = 4096
BLOCK = 1 << 20


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` bytes."""
    return _run_hashes(BYTE_VALUE[data], width)[0]


def _run_hashes(values: np.ndarray, *widths: int) -> list[np.ndarray]:
    """Hash of each run of each width of values."""
    n = len(values)
    if n < min(widths):
        return [np.zeros(0, np.uint64)] * len(widths)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power("up", BASE, n), out=total[1:])
    return [mix((total[w:] - total[: n + 1 - w]) * _power("down", BASE_INVERSE, n)[: n - w + 1]) if n >= w else np.zeros(0, np.uint64) for w in widths]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each `width` neighbours: running extremes inside blocks, from both sides."""
    n = len(values)
    rows = -(-n // width)
    fill = np.iinfo(values.dtype).max if pick is np.minimum else 0
    padded = np.full(rows * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every anchor of a text of LENGTH bytes or more."""
    h = window_hashes(data, ANCHOR)
    width = LENGTH - ANCHOR + 1
    least = _sliding(h, width, np.minimum)
    # a run is an anchor if it is the smallest of a window that holds it: if the largest minimum around it is itself
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(around, width, np.maximum) == h)
    return at, h[at]


def stretches(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place and hash of each stretch of places of one anchor whose segments overlap."""
    order = np.lexsort((at, h))
    at, h = at[order], h[order]
    new = np.ones(len(at), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] - at[:-1] >= 2 * LENGTH - ANCHOR)
    start = np.flatnonzero(new)
    return at[start], at[np.append(start[1:], len(at))[: len(start)] - 1], h[start]


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each row; row, hash and anchor of every window of PASSAGE words inside a row."""
    n_rows = len(offsets) - 1
    _, _, row, h = words(data, offsets, lower=False)
    count = np.bincount(row, minlength=n_rows)
    run, window = _run_hashes(h, RUN, PASSAGE)
    if not len(window):
        return count, np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2
    ok = np.flatnonzero(row[: len(window)] == row[PASSAGE - 1 :])
    least = _sliding(run, PASSAGE - RUN + 1, np.minimum)
    return count, row[ok], window[ok], least[ok]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        data, at = text_bytes(batch.column("text"))
        raw = data.tobytes()
        where, until, what, sha = [], [], [], []
        n_words, row, _, least = passages(data, at)
        cut = np.searchsorted(row, np.arange(len(at))).tolist()
        for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
            sha.append(hashlib.sha256(raw[a:b]).digest())
            p, h = anchors(data[a:b]) if b - a >= LENGTH else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            first, last, h = stretches(p, h)
            runs = np.unique(least[cut[k] : cut[k + 1]])
            none = np.full(len(runs), -1)  # anchors of words go by their hash alone
            where += [first, none]
            until += [last, none]
            what += [h, runs]
        cut = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in where])])[::2], pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate(x or [[]]).astype(kind).view(np.int64), pa.int64())) for x, kind in ((what, np.uint64), (where, np.int64), (until, np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n_words, pa.int64()), pa.array(sha, pa.binary()), *lists], ["doc_id", "n_bytes", "n_words", "sha", "anchors", "places", "lasts"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch of a repeated anchor of a text the bytes around it."""
    reach = LENGTH - ANCHOR
    for batch in by_bytes(batches, "text", 1 << 18):
        out = []
        for sha, text, what, where, until in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "anchors", "places", "lasts"))):
            raw = text.encode()
            for h, p, q in zip(what, where, until):
                if p < 0:
                    continue
                a, b = max(0, p - reach), min(len(raw), q + LENGTH)
                out.append((h, sha, a, b, raw[a:b]))
        cols = list(zip(*out)) or [()] * 5
        keys = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in cols[4]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(keys, pa.int64()), pa.array(cols[4], pa.binary())], ["anchor", "sha", "start", "segment", "bytes"])


_WINDOWS = "window long, text long, n long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text, which has a number, the windows of PASSAGE words whose anchor is repeated, and how often it has each."""
    for batch in by_bytes(batches, "text"):
        _, row, window, least = passages(*text_bytes(batch.column("text")))
        asked = batch.column("anchors").flatten().to_numpy()[batch.column("places").flatten().to_numpy() < 0]
        ok = np.isin(least.view(np.int64), asked)
        row, window = row[ok], window[ok].view(np.int64)
        order = np.lexsort((window, row))
        row, window = row[order], window[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1])
        start = np.flatnonzero(new)
        cols = [window[start], batch.column("number").to_numpy()[row[start]], np.diff(start, append=len(row))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in _WINDOWS.split(", ")])


def suffix_order(text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes sorted inside each group (groups in a row), and the rank of each by its first 4, 8, 16 ... symbols."""
    n = len(text)
    key = group.astype(np.uint64) << np.uint64(36)
    for k in range(4):
        key[: n - k] |= text[k:].astype(np.uint64) << np.uint64(27 - 9 * k)
    left, width, ranks = np.arange(n), 4, []
    rank = np.zeros(n, np.int64)  # the place of the first of equals, so a suffix like no other keeps its own
    while True:
        order = np.argsort(key)
        left, key, old = left[order], key[order], rank[left[order]]
        first, new = (np.concatenate([[True], x[1:] != x[:-1]]) for x in (old, key))
        at = np.arange(len(left))
        rank[left] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        ranks.append((width, rank.astype(np.int32)))
        left = left[~(new & np.append(new[1:], True))]
        if not len(left):
            order = np.empty(n, np.int64)
            order[rank] = np.arange(n)
            return order, ranks
        following = np.zeros(len(left), np.int64)
        inside = left + width < n
        following[inside] = rank[left[inside] + width] + 1
        key = rank[left] * (n + 2) + following
        width *= 2


def common(a: np.ndarray, b: np.ndarray, ranks: list[tuple[int, np.ndarray]], text: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at each two places: by their ranks from long to short, then by symbols."""
    n = len(text)
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for width, rank in reversed(ranks):
        same = (a < n) & (b < n)
        same[same] = rank[a[same]] == rank[b[same]]
        total[same] += width
        a[same] += width
        b[same] += width
    going = np.ones(len(a), bool)
    for _ in range(3):
        going &= (a < n) & (b < n)
        going[going] = text[a[going]] == text[b[going]]
        total += going
        a += going
        b += going
    return total


def matching_statistics(texts: list[bytes], groups: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each byte of the texts, longest match of what starts there with anything else of its group in order.

    Also where each text starts, and the number of runs of the transform. The texts of a group must be in a row.
    """
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    text[start + size] = 0  # ends a text, below every byte
    n = len(text)
    group = np.repeat(np.asarray(groups, np.int64), size + 1)
    suffixes, ranks = suffix_order(text, group)
    before = np.full(n, -1, np.int64)  # the transform; what stands before a text is like nothing else
    before[1:] = text[:-1]
    before[start] = 512 + np.arange(len(start))
    transform, of = before[suffixes], group[suffixes]
    same_group = of[1:] == of[:-1]
    cut = (transform[1:] != transform[:-1]) | ~same_group
    head, tail = np.concatenate([[True], cut]), np.concatenate([cut, [True]])
    stop = np.repeat(start + size, size + 1)
    best = np.zeros(n, np.int64)
    for ends, shift in ((head, -1), (tail, 1)):
        at = np.flatnonzero(ends)
        other = at + shift
        ok = (other >= 0) & (other < n)
        ok[ok] = of[at[ok]] == of[other[ok]]
        here = suffixes[at]
        reach = here.copy()
        reach[ok] += common(here[ok], suffixes[other[ok]], ranks, text)
        sampled = np.full(n, -1, np.int64)
        sampled[here] = reach
        last = np.maximum.accumulate(np.where(sampled >= 0, np.arange(n), 0))
        best = np.maximum(best, sampled[last] - np.arange(n))
    return np.maximum(np.minimum(best, stop - np.arange(n)), 0), start, int(head.sum())


def covered(best: np.ndarray, start: int, size: int) -> list[tuple[int, int]]:
    """Maximal spans of a text that matches of LENGTH or more cover, from its matching statistics."""
    own = best[start : start + size]
    at = np.flatnonzero(own >= LENGTH)
    if not len(at):
        return []
    end = np.maximum.accumulate(at + own[at])
    new = np.concatenate([[True], at[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return list(zip(at[first].tolist(), end[np.append(first[1:] - 1, len(at) - 1)].tolist()))


_MARKS = "anchor long, segment long, at long, to long"


def _marks(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "segment", "at", "to"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks inside the segments of each anchor; anchors are taken together up to BLOCK bytes."""
    texts, groups, names, total = [], [], [], 0

    def done() -> pa.RecordBatch:
        best, start, _ = matching_statistics(texts, groups)
        return _marks([(*name, a, b) for name, s, t in zip(names, start.tolist(), texts) for a, b in covered(best, s, len(t))])

    for k, table in enumerate(runs_of(batches, ["anchor"])):
        if table.num_rows > 1 or len(table["bytes"][0].as_py()) > LENGTH:
            for anchor, segment, raw in zip(*(table[c].to_pylist() for c in ("anchor", "segment", "bytes"))):
                texts.append(raw)
                groups.append(k & 0x7FFFFF)
                names.append((anchor, segment))
                total += len(raw)
        if total >= BLOCK or len(texts) > 100_000:
            yield done()
            texts, groups, names, total = [], [], [], 0
    if texts:
        yield done()


_SLICES = "part long, slice long, near long, far long, anchor long, segment long, offset long, place long, bytes binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two slices of each segment whose windows start `near` to `far` bytes before the anchor: its nearer and farther half."""
    for batch in by_bytes(batches, "bytes", 1 << 18):
        out = []
        for anchor, segment, near, far, place, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "near", "far", "place", "bytes"))):
            middle, places = (near + far) // 2, [place]
            if place < 0:
                places = np.flatnonzero(window_hashes(np.frombuffer(raw, np.uint8), ANCHOR).view(np.int64) == anchor).tolist()
            for p in places:
                for a, b in ((near, middle), (middle + 1, far)):
                    if a > b or p < a or p + LENGTH - b > len(raw):
                        continue  # no window of these starts fits into the text
                    lo, hi = max(0, p - b), min(len(raw), p + LENGTH - a)
                    part = hashlib.blake2b(b"%d %d %d " % (anchor, a, b) + raw[p - a : p + LENGTH - b], digest_size=8).digest()
                    name = hashlib.blake2b(b"%d " % (p - lo) + raw[lo:hi], digest_size=8).digest()
                    out.append((int.from_bytes(part, "little", signed=True), int.from_bytes(name, "little", signed=True), a, b, anchor, segment, lo, p - lo, raw[lo:hi]))
        cols = list(zip(*out)) or [()] * 9
        kinds = [*[pa.int64()] * 8, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in _SLICES.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length, removed bytes, spans and rest of each text with marks."""
    for batch in by_bytes(batches, "text"):
        out = []
        for sha, text, marks in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "marks"))):
            raw = text.encode()
            spans: list[list[int]] = []
            for m in sorted((m["at"], m["to"]) for m in marks):
                if spans and m[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m[1])
                else:
                    spans.append(list(m))
            rest, last = [], 0
            for a, b in spans:
                rest.append(raw[last:a])
                last = b
            rest.append(raw[last:])
            out.append((sha, sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(rest)).hexdigest(), [{"at": a, "to": b} for a, b in spans]))
        cols = list(zip(*out)) or [()] * 5
        span = pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())]))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), span]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["sha", "n_removed", "n_spans", "kept_sha256", "spans"])


def _all_marks(segments: DataFrame) -> DataFrame:
    """anchor, segment, at, to: what is repeated of each distinct segment (anchor, segment, near, far, place, bytes, copies)."""
    whole = segments.where("copies > 1").select("anchor", "segment", F.lit(0).cast("long").alias("at"), F.length("bytes").cast("long").alias("to"))
    kinds = written(segments.groupBy("anchor").agg(F.count("*").alias("kinds")))
    sized = segments.join(kinds.hint("merge"), "anchor")
    cold = sized.where(F.col("kinds") <= HOT).select("anchor", "segment", "bytes")
    marks = whole.unionByName(cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index, _MARKS))
    if kinds.where(F.col("kinds") > HOT).isEmpty():
        return marks
    hot = sized.where(F.col("kinds") > HOT).select("anchor", "segment", "near", "far", "place", "bytes")
    slices = written(hot.mapInArrow(_slices, _SLICES))
    first = [F.first(c).alias(c) for c in ("near", "far", "place", "bytes")]
    distinct = written(slices.groupBy(F.col("part").alias("anchor"), F.col("slice").alias("segment")).agg(*first, F.count("*").alias("copies")))
    found = _all_marks(distinct).select(F.col("anchor").alias("part"), F.col("segment").alias("slice"), "at", "to")
    own = slices.select("part", "slice", "anchor", "segment", "offset").join(found.hint("merge"), ["part", "slice"])
    return marks.unionByName(own.select("anchor", "segment", (F.col("offset") + F.col("at")).alias("at"), (F.col("offset") + F.col("to")).alias("to")))


def _shared_passages(texts: DataFrame) -> DataFrame:
    """sha, n_shared_passages of each text that shares a window of PASSAGE words with another text."""
    windows = written(texts.select("number", "text", "anchors", "places").mapInArrow(_windows, _WINDOWS))
    shared = written(windows.groupBy("window").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a < b").select("window"))
    found = windows.join(shared.hint("merge"), "window").groupBy(F.col("text").alias("number")).agg(F.sum("n").alias("n_shared_passages"))
    return texts.select("sha", "number").join(found.hint("merge"), "number").drop("number")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed bytes: at, to), n_shared_passages of every document.

    n_shared_passages counts the words at which a passage of PASSAGE words starts that another document holds too.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = written(docs.mapInArrow(_scan, "doc_id long, n_bytes long, n_words long, sha binary, anchors array<long>, places array<long>, lasts array<long>"))
    classes = rows.groupBy("sha").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"), F.first("places").alias("places"), F.first("lasts").alias("lasts"))
    number = F.xxhash64("sha").alias("number")  # shuffled in place of sha; if two texts had one number, each would be asked for the anchors of both
    places = classes.select(number, F.explode(F.arrays_zip("anchors", "places", "lasts")).alias("x")).select("number", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"), F.col("x.lasts").alias("last"))
    # written, so that adaptive execution can split the join's hot anchors: it can't where an aggregate feeds a join
    often = written(places.groupBy("anchor").agg(F.sum(F.when(F.col("last") > F.col("place"), 2).otherwise(1)).alias("n")).where("n > 1").select("anchor"))
    asked = places.join(often.hint("merge"), "anchor").groupBy("number").agg(F.collect_list(F.struct("anchor", "place", "last")).alias("a"))
    asked = asked.select("number", F.col("a.anchor").alias("anchors"), F.col("a.place").alias("places"), F.col("a.last").alias("lasts"))
    texts = docs.where(F.octet_length("text") >= min(LENGTH, 2 * PASSAGE - 1)).select(F.unhex(F.sha2("text", 256)).alias("sha"), "text").select("sha", number, "text")
    asked_texts = written(texts.join(asked.hint("merge"), "number").groupBy("number", "sha").agg(F.first("text").alias("text"), F.first("anchors").alias("anchors"), F.first("places").alias("places"), F.first("lasts").alias("lasts")))
    occurrences = written(asked_texts.mapInArrow(_segments, "anchor long, sha binary, start long, segment long, bytes binary"))
    segments = written(occurrences.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.first("bytes").alias("bytes")))
    start = [F.lit(n).cast("long").alias(c) for c, n in (("near", 0), ("far", LENGTH - ANCHOR), ("place", -1))]
    segments = segments.select("anchor", "segment", *start, "bytes", "copies")
    marks = _all_marks(segments)
    own = occurrences.select("anchor", "segment", "sha", "start").join(marks.hint("merge"), ["anchor", "segment"])
    own = own.groupBy("sha").agg(F.collect_set(F.struct((F.col("start") + F.col("at")).alias("at"), (F.col("start") + F.col("to")).alias("to"))).alias("marks"))
    cut = asked_texts.select("sha", "text").join(own.hint("merge"), "sha").mapInArrow(_cut, "sha binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<at: bigint, to: bigint>>")
    copies = rows.groupBy("sha").agg(F.count("*").alias("copies"))
    known = written(copies.join(cut.hint("merge"), "sha", "left").join(_shared_passages(asked_texts).hint("merge"), "sha", "left"))  # written for the same reason as `often`
    out = rows.select("doc_id", "n_bytes", "n_words", "sha").join(known.hint("merge"), "sha", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n_bytes").alias("to")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<at: bigint, to: bigint>>"))).alias("spans"),
        F.when((F.col("copies") > 1) & (F.col("n_words") >= PASSAGE), F.col("n_words") - (PASSAGE - 1)).otherwise(F.coalesce("n_shared_passages", F.lit(0))).alias("n_shared_passages"),
    )
