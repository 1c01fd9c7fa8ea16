"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z. An item of n words is compared with the
windows of n words of every document. A window's fingerprint is the SimHash of its five-word shingles, each weighted
by how often the window has it. Windows and items of weighted similarity (sum of smaller over sum of larger weights)
0.75 differ in 11 of the 64 bits on average, deviation 3, so RADIUS is 23: of 180,000 random pairs at the threshold, of 8
to 200 shingles, plain and repetitive, none was further apart (tests hold a smaller run; under 7 shingles only equal
ones are that similar). Fingerprints are cut into 8 blocks; two
within 23 bits agree up to 2 bits in one block at least, and tables by block value hold all items that near: the
search loses none within the radius. The exact weighted similarity then decides.
A document shorter than an item is its one window, whole, unless the sizes alone keep the similarity under SIMILARITY.

Windows without a shingle of an item of their size have similarity 0 and are left out before fingerprints are made.
Items of fewer than five words are one shingle, their whole sequence, which windows must equal.

The benchmark is the stated query set: it is read in blocks of at most ITEMS items (MB each), which travel with the
tasks, and every block is compared with all rows. Documents are scanned whole, without a shuffle.
Null and empty texts match nothing, nor does an empty table of either kind; items without words are ignored; equal items
and repeated rows match alike, each with a row of its own. Of equally similar windows the first counts. Very long texts
are compared whole, one at a time. Other columns are ignored, and kept by `drop_leaks`; documents without an id stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.licenses import license_words
from granary.llm.shared import by_bytes, mix, text_bytes
from granary.llm.shingles import _STEP, shingle_hashes

SIMILARITY = 0.75
RADIUS = 23
BLOCKS = 8
ITEMS = 20_000
SIZE = 5


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n (under five) words, as of a text that is only these words."""
    m = len(hashes) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += hashes[k : m + k] * _STEP[k]
    return mix(total ^ (np.uint64(n) << np.uint64(57)))


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash bytes of the windows of `width` shingles that start at `starts`."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(total[starts + width] > total[starts], axis=1)


_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class Items:
    """A block of benchmark items, by window size."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids, self.sets, self.sizes = [], [], []
        by_size: dict[int, list[int]] = {}
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            _, _, row, hashes = license_words(data, np.array([0, len(data)]))
            if len(hashes):
                by_size.setdefault(len(hashes), []).append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(shingle_hashes(hashes, row, 1)[0])
                self.sizes.append(len(hashes))
        self.by_size = {n: np.array(k) for n, k in by_size.items()}
        self.short = sorted(n for n in by_size if n < SIZE)
        owners: dict[int, set[int]] = {}
        for k, s in enumerate(self.sets):
            if self.sizes[k] >= SIZE:
                for v in s.tolist():
                    owners.setdefault(v, set()).add(k)
        self.known = np.array(sorted(owners), np.uint64)
        self.owners = [sorted(owners[v]) for v in self.known.tolist()]
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[(self.known >> np.uint64(44)).astype(np.int64)] = True
        near = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
        self.prints, self.tables = {}, {}
        for n, ks in self.by_size.items():
            if n >= SIZE:
                self.prints[n] = np.concatenate([fingerprints(self.sets[k], np.zeros(1, np.int64), n - SIZE + 1) for k in ks])
                # for each block and value: the items of this size within reach
                self.tables[n] = [near[:, self.prints[n][:, b]] for b in range(BLOCKS)]

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bloom[(shingles >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.known, shingles[maybe])
        ok = at < len(self.known)
        ok[ok] = self.known[at[ok]] == shingles[maybe][ok]
        return maybe[ok]

    def search(self, shingles: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Item, first word and similarity of all windows of a text that verify; `hits` are its known shingles."""
        owned: dict[int, list[int]] = {}
        for h, at in zip(hits.tolist(), np.searchsorted(self.known, shingles[hits]).tolist()):
            for k in self.owners[at]:
                owned.setdefault(k, []).append(h)
        sizes: dict[int, list[int]] = {}
        for k, at in owned.items():
            sizes.setdefault(self.sizes[k], []).extend(at)
        for n, at in sizes.items():
            width = min(n - SIZE + 1, len(shingles))  # of a document shorter than the item: all of it
            if width < SIMILARITY * (n - SIZE + 1):
                continue
            touched = np.zeros(len(shingles) + 1, np.int64)
            at = np.unique(at)
            np.add.at(touched, np.maximum(at - width + 1, 0), 1)
            np.add.at(touched, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(touched)[: len(shingles) - width + 1])
            if not len(starts):
                continue
            lo, hi = int(starts[0]), int(starts[-1]) + width
            prints = fingerprints(shingles[lo:hi], starts - lo, width)
            asked = np.zeros((len(starts), len(self.by_size[n])), bool)
            for b in range(BLOCKS):
                asked |= self.tables[n][b][prints[:, b]]
            w, i = np.nonzero(asked)
            close = _ONES[prints[w] ^ self.prints[n][i]].sum(axis=1) <= RADIUS
            for a, j in zip(starts[w[close]].tolist(), i[close].tolist()):
                k = int(self.by_size[n][j])
                share = weighted_similarity(shingles[a : a + width], self.sets[k])
                if share >= SIMILARITY:
                    yield k, a, share


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights, a shingle's weight being how often it occurs."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(at[: len(a)], minlength=len(values))
    y = np.bincount(at[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _search(items: Items):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            start, end, row, hashes = license_words(data, at)
            best: dict[tuple[int, int], tuple[float, int]] = {}
            word_at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            full = np.flatnonzero(row[: len(row) - SIZE + 1] == row[SIZE - 1 :]) if len(row) >= SIZE else np.zeros(0, np.int64)
            shingles, of = shingle_hashes(hashes, row, batch.num_rows)
            keep = np.diff(word_at)[of] >= SIZE
            shingles, of = shingles[keep], of[keep]
            cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
            assert len(full) == len(shingles)
            hits = items.hits(shingles)
            for r in np.unique(of[hits]).tolist():
                own = hits[(hits >= cut[r]) & (hits < cut[r + 1])] - cut[r]
                for k, a, share in items.search(shingles[cut[r] : cut[r + 1]], own):
                    if (r, k) not in best or share > best[r, k][0]:
                        best[r, k] = (share, a)
            for n in items.short:
                runs = sequences(hashes, n)
                whole = row[: len(runs)] == row[n - 1 :] if len(runs) else np.zeros(0, bool)
                for k in items.by_size[n].tolist():
                    for w in np.flatnonzero(whole & (runs == items.sets[k][0])).tolist():
                        best.setdefault((int(row[w]), k), (1.0, w - int(word_at[row[w]])))
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            out = []
            ids = batch.column("doc_id")
            for (r, k), (share, a) in sorted(best.items()):
                w0 = word_at[r] + a
                w1 = min(w0 + items.sizes[k], word_at[r + 1]) - 1
                out.append((ids[r].as_py(), items.ids[k], share, int(point[start[w0]] - point[at[r]]), int(point[end[w1]] - point[at[r]])))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "similarity", "start", "end"])

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start, end (code points) of the best window for each item a document holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n_blocks = max(1, -(-items.count() // (ITEMS // 2)))
    found = []
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks)) == b).orderBy("item_id", "text").collect()  # half of ITEMS on average
        found.append(rows.mapInArrow(_search(Items([(r.item_id, r.text) for r in block])), "doc_id long, item_id long, similarity double, start long, end long"))
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark item, all columns as they were."""
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_leak_id")).distinct()
    return docs.join(leaks, docs.doc_id.eqNullSafe(leaks._leak_id), "left_anti")
