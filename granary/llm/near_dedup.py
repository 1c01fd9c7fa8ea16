"""MinHash near-dedup: a chosen-path set similarity join.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes). Equal sets are one class, which its
   smallest doc_id stands for; copies are never paired with one another.
2. Each class is embedded as TOKENS minwise tokens (coordinate, smallest hash). In each of TREES independent trees a
   class walks from the root to every child whose token a hash of (path, token) selects; BRANCH children are expected
   in each step. A pair of similarity s shares BRANCH * s children of a common node on average, so with s = 0.75 one
   tree misses it with probability exp(-1.5) = 0.22 in the first step, and all 12 trees with 1.4e-8.
3. A node of at most LEAF classes is compared exhaustively on the tokens: on FIRST of them, then on all. A class is
   not compared with those already in its cluster, so near copies cost little. A larger node branches again.
   Comparisons only gather classes that may be linked (estimated similarity of CANDIDATE or more) into clusters, by one
   star per node instead of all its pairs. From step GATHER on, a larger node (mostly near copies of one text) is first
   compared with LEADERS of its classes, which is linear; once all its classes are in one cluster it needs no more
   comparison, for step 4 decides clusters. The others branch on, and what is larger at DEPTH still becomes one cluster
   as a whole, so no pair that shares a node goes undecided. However deep a tree goes, a pair with s = 0.75 stays
   together in some node with probability 0.58, and all 12 trees lose it with 2.8e-5.
4. Inside clusters, links are decided on the full sets: 100 * intersection >= 75 * union. A cluster over BLOCK_SETS
   classes or BLOCK_SHINGLES shingles is dealt into blocks. Each block is first decided together with LEADERS classes
   of the cluster, which is linear and connects most near copies. Pairs inside the largest component found so need no
   more; the classes outside of it are compared with all blocks. No task holds an unbounded group, and no link between
   components is lost.

Joins with whole-corpus tables are always sort-merge joins, so the plan and its disk use are alike at every size.

Nulls and texts without words have an empty set and are linked with nothing. Rows that share a doc_id count as one
document; a null doc_id never stands for a class. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import blob_rows, by_bytes, components, drop_written, mix, runs_of, text_bytes, written
from granary.llm.shingles import row_sets

TOKENS = 128
TREES = 12
BRANCH = 2.0
GATHER = 2
DEPTH = 6
LEAF = 4096
LEADERS = 8
#: 0.75 less over five standard deviations of an estimate from 128 tokens.
CANDIDATE = 0.55
#: Tokens compared first, and how many of them must agree: fewer agree for 3 in a million pairs of similarity 0.75.
FIRST = 32
FIRST_EQUAL = 12
BLOCK_SETS = 2048
BLOCK_SHINGLES = 2_000_000
#: Edges that one task contracts at once.
BLOCK_EDGES = 1 << 18
LOW = f"substring(tokens, 1, {TOKENS}) AS low"

_rng = np.random.default_rng(75)
_MULTIPLY = (_rng.integers(1, 2**63, TOKENS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64)
_COORDINATE = mix(np.arange(1, TOKENS + 1, dtype=np.uint64))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each of TOKENS hash functions (upper 32 bits)."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        part = (shingles[None, a : a + 2048] ^ _XOR[:, None]) * _MULTIPLY[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        sets = row_sets(*text_bytes(batch.column("text")))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        tokens = np.stack([minwise(s) if len(s) else np.zeros(TOKENS, np.uint32) for s in sets])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), blob_rows(_packed(tokens))], ["doc_id", "n_shingles", "digest", "tokens"])


def _packed(tokens: np.ndarray) -> np.ndarray:
    """Tokens as bytes, the lowest byte of each first, so that a prefix of TOKENS bytes is enough to compare sets."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, TOKENS, 4).transpose(0, 2, 1)).reshape(-1, 4 * TOKENS)


def _tokens(column: pa.Array) -> np.ndarray:
    data, _ = text_bytes(column)
    return np.ascontiguousarray(data.reshape(-1, 4, TOKENS).transpose(0, 2, 1)).view(np.uint32)[..., 0]


def _low(column: pa.Array) -> np.ndarray:
    return text_bytes(column)[0].reshape(-1, TOKENS)


def _children(tokens: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and child node for every selected token of each row, below the node `path` of that row."""
    mixed = mix((tokens.astype(np.uint64) + (_COORDINATE << np.uint64(32))) ^ _COORDINATE ^ path[:, None])
    row, k = np.nonzero(mixed < np.uint64(int(BRANCH / TOKENS * 2**64)))
    return row, mix(mixed[row, k] ^ path[row])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = mix(np.arange(101, 101 + TREES, dtype=np.uint64))
    for big in batches:
        for a in range(0, big.num_rows, 1000):
            batch = big.slice(a, 1000)
            tokens, ids = _tokens(batch.column("tokens")), batch.column("rep").to_numpy()
            parts = [_children(tokens, np.full(len(ids), s)) for s in seeds]
            row, node = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[row])], ["node", "rep"])


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for a in range(0, big.num_rows, 10_000):
            batch = big.slice(a, 10_000)
            row, node = _children(_tokens(batch.column("tokens")), batch.column("node").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(batch.column("rep").to_numpy()[row])], ["node", "rep"])


def star_labels(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row of its connected component."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _links(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a) if a else np.zeros(0, np.int64), pa.int64()), pa.array(np.concatenate(b) if b else np.zeros(0, np.int64), pa.int64())], ["a", "b"])


def gathered(low: np.ndarray) -> np.ndarray:
    """For each row of tokens the smallest row of its cluster of rows that may be linked."""
    n = len(low)
    label, first = np.arange(n), np.ascontiguousarray(low[:, :FIRST])
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(rest):
            continue
        rest = rest[np.count_nonzero(first[rest] == first[i], axis=1) >= FIRST_EQUAL]
        rest = rest[np.count_nonzero(low[rest] == low[i], axis=1) >= CANDIDATE * TOKENS]
        if len(rest):
            merged = np.unique(np.append(label[rest], label[i]))
            label[np.isin(label, merged)] = merged[0]
    return label


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exhaustive comparison inside each node; rows come sorted by node."""
    out_a, out_b, held, waiting = [], [], 0, []

    def pairs() -> None:  # nodes of two, many at a time
        ids = np.stack([x for x, _ in waiting])
        t = np.stack([x for _, x in waiting])
        ok = (t[:, 0] == t[:, 1]).mean(axis=1) >= CANDIDATE
        out_a.append(ids[ok, 0])
        out_b.append(ids[ok, 1])
        waiting.clear()

    for group in runs_of(batches, ["node"]):
        ids, low = group.column("rep").to_numpy(), _low(group.column("low"))
        if len(ids) == 2:
            waiting.append((ids, low))
            if len(waiting) == 4096:
                pairs()
        elif len(ids) > 2:
            label = gathered(low)
            other = label != np.arange(len(ids))
            out_a.append(ids[label[other]])
            out_b.append(ids[other])
        held += len(ids)
        if held > 200_000:
            yield _links(out_a, out_b)
            out_a, out_b, held = [], [], 0
    if waiting:
        pairs()
    yield _links(out_a, out_b)


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the leaders of its node."""
    for big in batches:
        for a in range(0, big.num_rows, 2000):
            batch = big.slice(a, 2000)
            low, ids = _low(batch.column("low")), batch.column("rep").to_numpy()
            best, to = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for k in range(LEADERS):
                s = (low == _low(batch.column(f"low{k}"))).mean(axis=1)
                better = s > best
                best[better], to[better] = s[better], batch.column(f"rep{k}").to_numpy()[better]
            ok = best >= CANDIDATE - 0.05
            yield _links([ids[ok]], [to[ok]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        sets = row_sets(*text_bytes(batch.column("text")))
        kept = [batch.column(k) for k in ("cluster", "i", "j", "rep")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([s.tobytes() for s in sets], pa.binary())], ["cluster", "i", "j", "rep", "shingles"])


def exact_links(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of links between sets of sorted distinct hashes: 100 * intersection >= 75 * union, neither of them empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = np.array([[sizes[0], n := len(np.intersect1d(*sets, assume_unique=True))], [n, sizes[1]]], np.float64)
    else:
        values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = count[at] > 1
        column = np.cumsum(count > 1)[at[shared]] - 1
        owner = owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both, width = np.zeros((len(sets), len(sets)), np.float32), max(64, min(4096, 8_000_000 // len(sets)))
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            has = np.zeros((len(sets), width), np.float32)
            has[owner[lo:hi], column[lo:hi] - a] = 1
            both += has @ has.T
        both = both.astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - both
    return (100 * both >= 75 * union) & (sizes > 0)[:, None] & (sizes > 0)[None, :]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links on the full sets inside each (cluster, block, block), as one star per component."""
    out_a, out_b = [], []
    for group in runs_of(batches, ["cluster", "i", "j"]):
        ids = group.column("rep").to_numpy()
        data, at = text_bytes(group.column("shingles"))
        if len(ids) > 1:
            label = star_labels(exact_links([np.frombuffer(data[a:b].tobytes(), np.uint64) for a, b in zip(at, at[1:])]))
            other = label != np.arange(len(ids))
            out_a.append(ids[label[other]])
            out_b.append(ids[other])
        if len(out_a) > 5000:
            yield _links(out_a, out_b)
            out_a, out_b = [], []
    yield _links(out_a, out_b)


def _union(edges: list[DataFrame]) -> DataFrame:
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def _led_edges(large: DataFrame, reps: DataFrame, old: list[DataFrame]) -> DataFrame:
    """Each class of the nodes `large` (node, rep) against LEADERS classes of its node."""
    rows = written(large.join(reps.hint("merge"), "rep").selectExpr("node", "rep", LOW))
    pick = [F.min_by(F.struct("rep", "low"), F.xxhash64("rep", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)]
    flat = [F.col(f"l{k}.{c}").alias(f"{c}{k}") for k in range(LEADERS) for c in ("rep", "low")]
    leaders = written(rows.groupBy("node").agg(*pick).select("node", *flat))
    old += [rows, leaders]
    return rows.join(leaders, "node").mapInArrow(_led, "a long, b long")


def _unresolved(large: DataFrame, labels: DataFrame, old: list[DataFrame]) -> DataFrame:
    """Rows (node, rep, label, low) of the nodes that hold several clusters; `low` is the node's smallest label."""
    named = written(large.join(labels.hint("merge"), large.rep == labels.v, "left").select("node", "rep", F.coalesce("root", "rep").alias("label")))
    several = written(named.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("node", "low"))
    old += [named, several]
    return named.join(several.hint("merge"), "node")


def candidate_clusters(reps: DataFrame) -> DataFrame:
    """`v`, `root`: clusters of the classes in `reps` (rep, tokens) that may be linked."""
    found, old, labels = [], [], None
    rows = reps.mapInArrow(_roots, "node long, rep long")
    for depth in range(1, DEPTH + 1):
        rows = rows.distinct() if depth > 1 else rows
        # written, so that adaptive execution can split hot nodes: it can't where an aggregate feeds a join
        sizes = written(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        nodes = written(rows.join(sizes.hint("merge"), "node"))
        old += [sizes, nodes]
        full = nodes.where(F.col("n") <= LEAF).join(reps.hint("merge"), "rep").selectExpr("node", "rep", LOW)
        found.append(full.repartition("node").sortWithinPartitions("node").mapInArrow(_leaves, "a long, b long"))
        large = nodes.where(F.col("n") > LEAF).select("node", "rep")
        if large.isEmpty():
            break
        if depth >= min(GATHER, DEPTH):
            if labels is None:
                labels = written(components(_union([*found, _led_edges(large, reps, old)]), block=BLOCK_EDGES))
                old.append(labels)
                found = [labels.select(F.col("v").alias("a"), F.col("root").alias("b"))]
            large = written(_unresolved(large, labels, old))
            old.append(large)
            if large.isEmpty():
                break
        if depth < DEPTH:
            rows = large.join(reps.hint("merge"), "rep").select("node", "rep", "tokens").mapInArrow(_branches, "node long, rep long")
        else:
            found.append(large.select(F.col("label").alias("a"), F.col("low").alias("b")).distinct())
    out = components(_union(found), block=BLOCK_EDGES)
    for x in old:
        drop_written(x)
    return out


def _decided(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Links on the full sets inside each group (cluster, i, j, rep)."""
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(groups.hint("merge"), "rep").select("cluster", "i", "j", "rep", "text")
    sets = texts.mapInArrow(_sets, "cluster long, i int, j int, rep long, shingles binary")
    return sets.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_decide, "a long, b long")


def _in_blocks(rows: DataFrame, key: str, size: int, shingles: int) -> DataFrame:
    """`rows` (cluster, rep, n_shingles) with their block `own` and `n_blocks`, numbered for each (cluster, key)."""
    sizes = written(rows.groupBy("cluster", key).agg(F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum("n_shingles") / shingles)).cast("int").alias("n_blocks")))
    return rows.join(sizes.hint("merge"), ["cluster", key]).withColumn("own", F.pmod(F.xxhash64("rep"), "n_blocks").cast("int"))


def _large_links(docs: DataFrame, large: DataFrame) -> DataFrame:
    """Links in clusters of several blocks (cluster, rep, n_shingles, own, n_blocks); those inside a component may lack."""
    pick = F.array(*[F.min_by(F.struct("rep", "n_blocks"), F.xxhash64("rep", F.lit(k))) for k in range(LEADERS)])
    leaders = large.groupBy("cluster").agg(F.array_distinct(pick).alias("l")).select("cluster", F.explode("l").alias("l"))
    everywhere = leaders.select("cluster", F.explode(F.sequence(F.lit(0), F.col("l.n_blocks") - 1)).alias("i"), F.lit(-1).alias("j"), F.col("l.rep").alias("rep"))
    own = large.select("cluster", F.col("own").alias("i"), F.lit(-1).alias("j"), "rep")
    first = written(_decided(docs, written(own.unionByName(everywhere).distinct())))
    roots = components(first, block=BLOCK_EDGES)
    named = written(large.join(roots.hint("merge"), large.rep == roots.v, "left").select("cluster", "rep", "n_shingles", F.coalesce("root", "rep").alias("part")))
    counts = named.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    main = written(counts.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main")))
    sided = named.join(main.hint("merge"), "cluster").select("cluster", "rep", "n_shingles", (F.col("part") != F.col("main")).alias("outside"))
    blocks = written(_in_blocks(sided, "outside", BLOCK_SETS // 2, BLOCK_SHINGLES // 2))
    count = lambda side: F.coalesce(F.max(F.when(F.col("outside") == side, F.col("n_blocks"))), F.lit(0))
    both = written(blocks.groupBy("cluster").agg(count(True).alias("n_out"), count(False).alias("n_in")).where("n_out > 0"))
    rows = blocks.join(both.hint("merge"), "cluster").withColumn("own", F.when(F.col("outside"), F.col("own")).otherwise(F.col("n_out") + F.col("own")))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), F.col("n_out") + F.col("n_in") - 1).otherwise(F.col("n_out") - 1))))
    pairs = met.where("own <> other or n_out + n_in = 1").select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep")
    return first.unionByName(_decided(docs, pairs))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is component_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, tokens binary"))
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    per_class = rows.join(classes.hint("merge"), (rows.digest == classes.digest) & (rows.doc_id == classes.rep)).select("rep", "tokens", "n_shingles").dropDuplicates(["rep"])
    reps = written(per_class)
    clusters = written(candidate_clusters(reps.select("rep", "tokens")).join(reps.select(F.col("rep").alias("v"), "n_shingles"), "v").select(F.col("root").alias("cluster"), F.col("v").alias("rep"), "n_shingles"))
    blocks = written(_in_blocks(clusters.withColumn("side", F.lit(0)), "side", BLOCK_SETS, BLOCK_SHINGLES))
    links = _decided(docs, blocks.where("n_blocks = 1").select("cluster", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep"))
    large = blocks.where("n_blocks > 1").drop("side")
    if not large.isEmpty():
        links = links.unionByName(_large_links(docs, large))
    roots = written(components(links, block=BLOCK_EDGES))
    named = classes.join(roots, classes.rep == roots.v, "left").select(classes.digest, F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(named.hint("merge"), "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one document, the smallest doc_id, of each group of near copies, all columns as they were."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept._kept_id), "left_semi")
