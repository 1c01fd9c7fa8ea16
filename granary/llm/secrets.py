"""Secret scans: three base rules, and a character convolutional network over every candidate in its context.

Base rules (code points, end exclusive): `assign` keyword assignments, `access` key ids, `hex` runs. Every run of 16
or more key characters with a letter and a digit that no base span touches is a candidate, and so is the key of every
base finding; the network reads each whole, with CONTEXT characters before and after it, in windows of WIDTH characters
that start STRIDE apart, and the largest score counts. Base findings stay whatever their score is; other candidates
become spans at the threshold. It is trained in numpy on labelled passages of all documents: every distinct base finding
in its context as a positive, every distinct other word of eight or more characters with a letter and a digit (dates,
addresses, file names: only such runs are ever asked) as a negative (each in the smallest of its passages), and drawn key material with and without a keyword beside both, also
inside long paths, so that a corpus without findings trains too. Passages are dealt by hash into shards of about
SHARD windows; in each of ROUNDS rounds every shard fits the network further, with both labels of equal weight, and the
mean of the shards' weights goes on. So the network does not depend on how Spark deals the rows. Scores are
calibrated by a logistic fit on the passages of a held-out third (all of them, counted by label and logit), and the
threshold is the highest one that still finds RECALL of its base findings and of its drawn keys.

The model is a few kB and travels with the tasks; every text is scanned whole in one pass without a shuffle.
Null is the empty text. Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import by_bytes, drop_written, runs_of, text_bytes, written
from granary.llm.shingles import LOWER

KINDS = ("assign", "access", "hex", "model")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORD = re.compile(r"(?<!\S)(?=\S*[0-9])(?=\S*[A-Za-z])\S{8,}")
CONTEXT, WIDTH, STRIDE = 24, 64, 32
CHUNK = 2048
SHARD, ROUNDS, EPOCHS = 20_000, 3, 4
#: Logits are counted in bins of this width.
BIN = 0.001
RECALL = 0.98
REPLACEMENT = "[SECRET]"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of every base finding, by start and then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of key characters with a letter and a digit that no base span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        run = m.group()
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not any(a < e and s < b for s, e, _ in spans):
            out.append((a, b))
    return out


def key_of(text: str, span: tuple[int, int, str]) -> tuple[int, int]:
    """Start and end of the key in a base finding: the value of an assignment, the whole of any other."""
    start, end, kind = span
    return (ASSIGN.match(text, start).start(2) if kind == "assign" else start), end


def passage(text: str, start: int, end: int) -> str:
    """A candidate with CONTEXT characters before and after it."""
    return text[max(0, start - CONTEXT) : start].rjust(CONTEXT) + text[start:end] + text[end : end + CONTEXT].ljust(CONTEXT)


def starts(length: int) -> list[int]:
    """Where the windows of a passage start: STRIDE apart, the last one ends with the passage."""
    last = max(0, length - WIDTH)
    return [*range(0, last, STRIDE), last]


def windows_of(whole: str) -> list[str]:
    """What the network reads of a passage; every stretch of WIDTH - STRIDE characters lies whole in one window."""
    return [whole[a : a + WIDTH].ljust(WIDTH) for a in starts(len(whole))]


def encode(windows: list[str]) -> np.ndarray:
    """Character classes 0 to 95: printable ASCII, anything else is the class of a space."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), WIDTH)
    return np.where((raw >= 32) & (raw < 127), raw - 32, 0).astype(np.int64)


class Network:
    """Character embedding, one convolution, largest and mean value of each filter, a logistic output."""

    def __init__(self, dims: int = 10, width: int = 5, filters: int = 24, seed: int = 9) -> None:
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {"e": r.normal(0, 0.5, (96, dims)), "w": r.normal(0, (2 / (dims * width)) ** 0.5, (dims * width, filters)), "b": np.zeros(filters), "v": r.normal(0, 0.1, 2 * filters), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.p["e"][x]
        n, length, dims = e.shape
        span = length - self.width + 1
        cols = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n * span, -1)
        h = np.maximum(cols @ self.p["w"] + self.p["b"], 0).reshape(n, span, -1)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return cols, h, top, pooled, pooled @ self.p["v"] + self.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[a : a + 512])[-1] for a in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scored(self.logits(x))

    def scored(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 3) -> None:
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), 64):
                at = order[a : a + 64]
                cols, h, top, pooled, z = self._forward(x[at])
                n, span, filters = h.shape
                dz = share[at] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[at]) / n
                dp = dz[:, None] * self.p["v"]
                dh = np.repeat(dp[:, None, filters:] / span, span, axis=1)
                np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :filters], 1)
                dh = (dh * (h > 0)).reshape(n * span, filters)
                dcols = (dh @ self.p["w"].T).reshape(n, span, self.width, -1)
                de = np.zeros((n, span + self.width - 1, dcols.shape[-1]))
                for k in range(self.width):
                    de[:, k : k + span] += dcols[:, :, k]
                ge = np.zeros_like(self.p["e"])
                np.add.at(ge, x[at], de)
                grads = {"e": ge, "w": cols.T @ dh, "b": dh.sum(0), "v": pooled.T @ dz, "c": np.array([dz.sum()])}
                t += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> None:
        """`calibrate_counts` of findings whose windows x holds; `first` is where each finding's begin, y has a label for each."""
        self.calibrate_counts(np.maximum.reduceat(self.logits(x), first), y, np.ones(len(y)), np.zeros(len(y), bool))

    def calibrate_counts(self, best: np.ndarray, y: np.ndarray, n: np.ndarray, drawn: np.ndarray) -> None:
        """Logistic scale and shift of the largest logits `best` of held-out passages, then the highest threshold with enough recall.

        y holds their labels, n how many passages there are of each, and `drawn` whether they were drawn.
        """
        share = np.where(y > 0, 0.5 / max(1, n[y > 0].sum()), 0.5 / max(1, n[y <= 0].sum())) * n
        unit = max(1e-9, (np.abs(best) * n).sum() / max(1, n.sum()))
        z, target = best / unit, np.where(y > 0, (n[y > 0].sum() + 1) / (n[y > 0].sum() + 2), 1 / (n[y <= 0].sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            a -= 0.5 * (share * (p - target) * z).sum()
            b -= 0.5 * (share * (p - target)).sum()
        self.scale, self.shift = a / unit, b
        least = []
        for group in ((y > 0) & drawn, (y > 0) & ~drawn):
            if n[group].sum():
                order = np.argsort(best[group], kind="stable")
                passed = np.cumsum(n[group][order])
                least.append(best[group][order][np.searchsorted(passed, int((1 - RECALL) * passed[-1]), "right")])
        if least:
            self.threshold = float(self.scored(np.array([min(least)]))[0])


def drawn_passages(n: int, words: list[str], seed: int = 17) -> list[tuple[str, list[int]]]:
    """Passages of drawn key material and of drawn identifiers, dates, paths and numbers, with a label for each window.

    A window with 20 or more characters of a key, or all of it, has label 1, one with none 0; the others have -1 and
    teach nothing.
    """
    r = random.Random(seed)
    words = words or ["the", "of", "value", "and", "page", "line"]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    alphabets = [letters, letters + "+/", letters + "_-", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    lead = ["key: ", "credential=", "auth = \"", "Bearer ", "private_key: '", "access ", "pwd: ", "", "", " "]
    tail = ["", " ", "\"", "'", ",", ".", ";", ")", "\n"]
    prefix = ["", "", "", "ghp_", "sk-", "xoxb-", "glpat-", "AIza"]
    some = lambda k: [r.choice(words) for _ in range(k)]

    def plain() -> str:
        kind = r.randrange(6)
        if kind == 0:
            return "-".join(some(4)) + f"-{r.randint(1, 2030)}"
        if kind == 1:
            return "/".join([*some(3), str(r.randint(1, 99999))])
        if kind == 2:
            return "_".join(some(3)) + f"_{r.randint(0, 99)}"
        if kind == 3:
            return f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}Z"
        if kind == 4:
            return "".join(w.capitalize() for w in some(4)) + str(r.randint(0, 999))
        return long()

    def long() -> str:
        return "".join(w + r.choice("//-_=") for w in some(r.randint(4, 24))) + str(r.randint(0, 9999))

    out = []
    for _ in range(n):
        before, after = " ".join(some(4)) + " ", r.choice(tail) + " ".join(some(4))
        key = r.choice(prefix) + "".join(r.choice(a) for a in [r.choice(alphabets)] for _ in range(r.randint(20, 48)))
        lead_in, run, at = before + r.choice(lead), key, 0
        if r.random() < 0.3:  # inside a long run
            head = long() + r.choice("/=-_")
            run, at = head + key + r.choice(["", "/" + long()]), len(head)
        whole = passage(lead_in + run + after, len(lead_in), len(lead_in) + len(run))
        a, b = CONTEXT + at, CONTEXT + at + len(key)
        held = [min(b, s + WIDTH) - max(a, s) for s in starts(len(whole))]
        out.append((whole, [1 if h >= min(20, len(key)) else 0 if h <= 0 else -1 for h in held]))
        run = plain()
        whole = passage(before + run + after, len(before), len(before) + len(run))
        out.append((whole, [0] * len(starts(len(whole)))))
    return out


def drawn_findings(n: int, words: list[str], seed: int = 17) -> tuple[list[str], list[int]]:
    """The labelled windows of drawn passages."""
    found = [(w, k) for whole, marks in drawn_passages(n, words, seed) for w, k in zip(windows_of(whole), marks) if k >= 0]
    return [w for w, _ in found], [k for _, k in found]


def _name(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled passages of every text: its base findings, and its other words that have a letter and a digit.

    Of a word the smallest passage in a part of the text is enough, as the smallest of all is taken afterwards.
    """
    for batch in by_bytes(batches, "text"):
        found, words = set(), {}
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            found |= {passage(text, *key_of(text, x)) for x in spans}
            for m in WORD.finditer(text):
                s, e = m.span()
                if not any(s < y and x < e for x, y, _ in spans):
                    whole = passage(text, s, e)
                    if words.setdefault(m.group(), whole) > whole:
                        words[m.group()] = whole
        names = [_name(p) for p in found] + [_name(w) for w in words]
        labels = pa.array([1] * len(found) + [0] * len(words), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), labels, pa.array([*found, *words.values()], pa.string())], ["name", "label", "passage"])


def labelled_passages(docs: DataFrame) -> DataFrame:
    """name, label, passage: every distinct base finding (1) and every distinct other word with a letter and a digit (0) of all documents."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_labelled, "name long, label int, passage string")
    return written(rows.groupBy("name", "label").agg(F.min("passage").alias("passage")))


def _held_out(name: int) -> bool:
    return name % 3 == 0


def _taught(model: Network, drawn: list[tuple[str, int]]):
    """The weights of the network after fitting it further on each shard and the drawn windows."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in runs_of(batches, ["shard"]):
            own = [(w, k) for p, k in zip(shard["passage"].to_pylist(), shard["label"].to_pylist()) for w in windows_of(p)]
            mine = copy.deepcopy(model)
            rows = own + drawn
            mine.fit(encode([w for w, _ in rows]), np.array([k for _, k in rows], np.float64), EPOCHS)
            weights = np.concatenate([v.ravel() for v in mine.p.values()])
            yield pa.RecordBatch.from_arrays([shard["shard"].combine_chunks().slice(0, 1), pa.array([len(own)], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["shard", "n", "weights"])

    return fit


def _logits(model: Network):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "passage", 1 << 18):
            best = best_logits(batch.column("passage").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.floor(np.array(best) / BIN).astype(np.int64))], ["label", "bin"])

    return read


def train(docs: DataFrame) -> Network:
    """A network fitted on the labelled passages of all documents and on drawn ones, calibrated on a held-out third of both."""
    rows = labelled_passages(docs)
    words = rows.select(F.explode(F.expr("regexp_extract_all(lower(passage), '([a-z]{2,})', 1)")).alias("w")).groupBy("w").count()
    passages = drawn_passages(1000, sorted(r.w for r in words.orderBy(F.desc("count"), "w").limit(500).collect()))
    held = np.array([_held_out(_name(p)) for p, _ in passages])
    drawn = [(w, k) for (p, marks), h in zip(passages, held) if not h for w, k in zip(windows_of(p), marks) if k >= 0]
    model = Network()
    model.fit(encode([w for w, _ in drawn]), np.array([k for _, k in drawn], np.float64))
    taught = rows.where(F.pmod("name", F.lit(3)) != 0)
    n = taught.agg(F.coalesce(F.sum(1 + F.ceil(F.length("passage") / STRIDE)), F.lit(0))).first()[0]
    dealt = taught.select(F.pmod(F.xxhash64("name"), F.lit(1 + n // SHARD)).alias("shard"), "name", "label", "passage")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "name", "label")
    for _ in range(ROUNDS):
        fitted = dealt.mapInArrow(_taught(model, drawn), "shard long, n long, weights binary").collect()
        if fitted:
            fitted = sorted(fitted, key=lambda r: r.shard)
            mean = np.average([np.frombuffer(r.weights) for r in fitted], axis=0, weights=[r.n for r in fitted])
            cuts = np.cumsum([v.size for v in model.p.values()])[:-1]
            model.p = {k: w.reshape(v.shape) for (k, v), w in zip(model.p.items(), np.split(mean, cuts))}
    counted = rows.where(F.pmod("name", F.lit(3)) == 0).mapInArrow(_logits(model), "label int, bin long").groupBy("label", "bin").count().orderBy("label", "bin").collect()
    kept = [(p, max(marks)) for (p, marks), h in zip(passages, held) if h]
    best = np.array([r.bin * BIN for r in counted] + best_logits([p for p, _ in kept], model))
    y = np.array([r.label for r in counted] + [k for _, k in kept], np.float64)
    model.calibrate_counts(best, y, np.array([r["count"] for r in counted] + [1] * len(kept), np.float64), np.array([False] * len(counted) + [True] * len(kept)))
    drop_written(rows)
    return model


def _flagged(data: np.ndarray, at: np.ndarray) -> list[int]:
    """Rows that may hold a finding or a candidate; the exact patterns then run on their whole texts only."""
    raw, low = data.tobytes(), LOWER[data].tobytes()
    hits = []
    for text, needles in ((low, [k.encode() for k in KEYWORDS]), (raw, [b"AKIA"])):
        for needle in needles:
            p = text.find(needle)
            while p >= 0:
                hits.append(p)
                p = text.find(needle, p + 1)
    for member, least in ((_HEX, 32), (_KEY, 16)):
        edge = np.diff(np.concatenate([[0], member[data].astype(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= least
        start, end = start[long], end[long]
        if least == 16 and len(start):
            digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
            has = digits[end] > digits[start]
            start, end = start[has], end[has]
        hits += start.tolist() + (end - 1).tolist()
        # a run may cross from one row into the next; both ends count
        hits += [int(p) for s, e in zip(start, end) for p in at[np.searchsorted(at, s, "right") : np.searchsorted(at, e)].tolist()]
    return np.unique(np.searchsorted(at, np.array([h for h in hits if h < len(data)], np.int64), "right") - 1).tolist()


def best_logits(passages: Iterable[str], model: Network) -> list[float]:
    """The largest window logit of each passage. Windows are read CHUNK at a time, so a long run stays bounded."""
    out: list[float] = []
    held: list[tuple[int, str]] = []

    def read() -> None:
        for (k, _), z in zip(held, model.logits(encode([w for _, w in held])) if held else []):
            out[k] = max(out[k], float(z))
        held.clear()

    for k, whole in enumerate(passages):
        out.append(-np.inf)
        for a in starts(len(whole)):
            held.append((k, whole[a : a + WIDTH].ljust(WIDTH)))
            if len(held) == CHUNK:
                read()
    read()
    return out


def scores(passages: Iterable[str], model: Network) -> list[float]:
    """The largest window score of each passage."""
    return model.scored(np.array(best_logits(passages, model))).tolist()


def scored_texts(texts: list[str], model: Network) -> list[list[tuple[int, int, str, float]]]:
    """All spans of each text with their scores: base findings, and the candidates that the network takes for secrets."""
    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    asked = []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        asked += [(i, key_of(text, s), s) for s in spans]
        asked += [(i, c, (*c, "model")) for c in candidates(text, spans)]
    for (i, _, span), score in zip(asked, scores((passage(texts[i], *key) for i, key, _ in asked), model)):
        if span[2] != "model" or score >= model.threshold:
            found[i].append((*span, score))
    return [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]))) for s in found]


def scan_texts(texts: list[str], model: Network) -> list[list[tuple[int, int, str]]]:
    """`scored_texts` without the scores."""
    return [[s[:3] for s in spans] for spans in scored_texts(texts, model)]


def _scan(model: Network):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            rows = _flagged(data, at) if len(data) else []
            column = batch.column("text")
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for i, s in zip(rows, scored_texts([column[i].as_py() or "" for i in rows], model)):
                spans[i] = s
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])
            out = pa.array([[{"start": a, "end": b, "kind": k, "score": p} for a, b, k, p in s] for s in spans], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), out], [*batch.schema.names, "spans"])

    return scan


SPANS = "spans array<struct<start: bigint, end: bigint, kind: string, score: double>>"


def find_secrets(docs: DataFrame, model: Network | None = None) -> DataFrame:
    """doc_id and spans (start, end, kind, score; code points, end exclusive) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(model or train(docs)), f"doc_id long, text string, {SPANS}").select("doc_id", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the SHA-256 of the base spans, and all spans and their scores as strings, of `find_secrets` rows."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(text(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256")
    marks = F.array_join(F.transform("spans", lambda s: F.format_string("%.3f", s["score"])), ",").alias("scores")
    return found.select("doc_id", *counts, base, text(F.col("spans")).alias("spans"), marks)


def _redact(model: Network, names: list[str]):
    scan = _scan(model)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    parts, last = [], 0
                    for s in spans:
                        if s["start"] >= last:
                            parts += [texts[i][last : s["start"]], REPLACEMENT]
                        last = max(last, s["end"])
                    texts[i] = "".join(parts) + texts[i][last:]
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return redact


def redact_secrets(docs: DataFrame, model: Network | None = None) -> DataFrame:
    """`docs` with every found span of `text` replaced by REPLACEMENT; all columns and rows stay."""
    names = [f"c{k}" if c != "text" else "text" for k, c in enumerate(docs.columns)]
    out = docs.toDF(*names).mapInArrow(_redact(model or train(docs), names), docs.toDF(*names).schema)
    return out.toDF(*docs.columns)
