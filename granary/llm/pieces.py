"""SentencePiece encoding and decoding with a suffix array over the batch.

The texts of a batch are cut into units that no piece crosses (spaces with the word after them; line ends and other
control characters alone). The distinct units that this task has not seen yet are concatenated, and their suffixes are
sorted. A binary search over the suffix array finds for every piece of the vocabulary the range of its occurrences; the
occurrences are the edges of a lattice, sorted by end position and then relaxed: the piece that ends a prefix's
encoding is the one whose predecessor, the last piece of the prefix before it, merges with it into these two pieces
and no others (merging is local, so an encoding is right when all its neighbours are). Characters outside the
vocabulary become byte pieces. Encodings of units are reused while they last in the task's bounded memory.

The result equals the public library's for merge models with byte fallback. Decoding joins the pieces, turns the
space mark into a space and drops the first one. A text with the space mark U+2581 itself comes back with a space,
as in the library; every other text comes back as it was. Null gives null; the empty text gives no pieces.
One scan of whole texts without a shuffle; the vocabulary (about 1 MB, a file whose path is a parameter) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import by_bytes, mix, text_bytes
from granary.llm.shingles import span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Units kept per task before its memory of encodings starts anew.
MEMORY = 600_000
#: Slots (as a power of two) for pairs of pieces whose fit is known; a later pair takes the slot of an earlier one.
PAIR_BITS = 22


def load_vocabulary(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces that merges can form, their scores and their ids, and the ids of the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return [model.id_to_piece(i) for i in range(model.get_piece_size())], [model.get_score(i) for i in range(model.get_piece_size())], plain, byte


class Encoder:
    """A vocabulary ready for matching, and the encodings of units seen so far."""

    def __init__(self, pieces: list[str], scores: list[float], plain: list[int], byte: list[int]) -> None:
        self.pieces, self.byte = pieces, np.array(byte, np.int32)
        self.id_of = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: scores[i] for i in plain}
        letters = sorted({c for i in plain for c in pieces[i]})
        self.letter = np.full(0x110000, 0xFFFF, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.ids = np.array(plain, np.int32)
        self.size = np.array([len(pieces[i]) for i in plain], np.int64)
        self.width = -(-int(self.size.max()) // 4)
        codes = np.zeros((len(plain), 4 * self.width), np.uint64)
        for k, i in enumerate(plain):
            codes[k, : len(pieces[i])] = self.letter[[ord(c) for c in pieces[i]]]
        self.low = self._pack(codes)
        codes[np.arange(4 * self.width)[None, :] >= self.size[:, None]] = 0xFFFF
        self.high = self._pack(codes)
        self.pairs = np.full(1 << PAIR_BITS, 2**64 - 1, np.uint64)
        self.pair_ok = np.zeros(1 << PAIR_BITS, bool)
        raw = [(bytes([byte.index(i)]) if i in set(byte) else pieces[i].replace(MARK, " ").encode()) for i in range(len(pieces))]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.forget()

    def forget(self) -> None:
        self.seen: dict[int, int] = {}
        self.flat: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    @staticmethod
    def _pack(codes: np.ndarray) -> np.ndarray:
        """Four 16-bit letters in a number, the first one highest."""
        c = codes.astype(np.uint64).reshape(len(codes), -1, 4)
        return (c[:, :, 0] << np.uint64(48)) | (c[:, :, 1] << np.uint64(32)) | (c[:, :, 2] << np.uint64(16)) | c[:, :, 3]

    def merged(self, text: str) -> list[str]:
        """A short text's encoding by merging the best-scored pair, leftmost first, again and again."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two pieces are the encoding of what they spell. Byte characters (-1) fit with anything."""
        out = (left < 0) | (right < 0)
        ask = np.flatnonzero(~out)
        key = (left[ask].astype(np.uint64) << np.uint64(32)) | right[ask].astype(np.uint64)
        slot = (mix(key) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.pairs[slot] != key)
        if len(new):
            distinct, back = np.unique(key[new], return_inverse=True)
            fresh = np.zeros(len(distinct), bool)
            for k, value in enumerate(distinct.tolist()):
                a, b = self.pieces[value >> 32], self.pieces[value & 0xFFFFFFFF]
                fresh[k] = self.merged(a + b) == [a, b]
            out[ask] = self.pair_ok[slot]
            out[ask[new]] = fresh[back]
            at = (mix(distinct) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            at, one = np.unique(at, return_index=True)
            self.pairs[at], self.pair_ok[at] = distinct[one], fresh[one]
            return out
        out[ask] = self.pair_ok[slot]
        return out

    def _edges(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start position and vocabulary index of every piece's every occurrence; units end with a zero letter."""
        n = len(letters)
        padded = np.concatenate([letters, np.zeros(4 * self.width, np.uint16)])
        keys = [sum(padded[4 * w + k : 4 * w + k + n].astype(np.uint64) << np.uint64(48 - 16 * k) for k in range(4)) for w in range(self.width)]
        suffix = np.lexsort(keys[::-1])
        ordered = [k[suffix] for k in keys]
        # the first four letters by one sorted search; then the rest of longer pieces inside that range
        bounds = [np.searchsorted(ordered[0], self.low[:, 0], "left"), np.searchsorted(ordered[0], self.high[:, 0], "right")]
        long = np.flatnonzero((self.size > 4) & (bounds[0] < bounds[1]))
        inner = [self._refine(ordered, want[long], bounds[0][long], bounds[1][long], right) for want, right in ((self.low, False), (self.high, True))]
        bounds[0][long], bounds[1][long] = inner
        count = bounds[1] - bounds[0]
        piece = np.repeat(np.arange(len(count)), count)
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[0], count)
        return suffix[rank], piece

    @staticmethod
    def _refine(ordered: list[np.ndarray], want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of each row of `want` between its bounds of the ordered suffixes."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            less, same = np.zeros(len(live), bool), np.ones(len(live), bool)
            for w in range(1, want.shape[1]):
                have = ordered[w][mid]
                less |= same & (have < want[live, w])
                same &= have == want[live, w]
            below = less | same if right else less
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units end to end, and how many each unit has."""
        joined = "\0".join(units) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(u) for u in units], np.int64)
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        letters = self.letter[points]
        letters[start + size] = 0
        at, piece = self._edges(letters)
        ids, width = self.ids[piece], self.size[piece]
        foreign = np.flatnonzero(letters == 0xFFFF)
        at = np.concatenate([at, foreign])
        ids = np.concatenate([ids, np.full(len(foreign), -1, np.int32)])
        end = at + np.concatenate([width, np.ones(len(foreign), np.int64)])
        unit = np.searchsorted(start, at, "right") - 1
        step = end - start[unit]
        order = np.argsort(step, kind="stable")
        at, ids, end, step, unit = at[order], ids[order], end[order], step[order], unit[order]
        last = np.full(len(points) + 1, -2, np.int32)
        came = np.full(len(points) + 1, -1, np.int64)
        cut = np.searchsorted(step, np.arange(1, int(step[-1]) + 2 if len(step) else 1))
        for a, b in zip(cut, cut[1:]):
            here = slice(a, b)
            first = at[here] == start[unit[here]]
            before = last[at[here]]
            ok = first | (before != -2)
            go = np.flatnonzero(ok & ~first)
            ok[go] = self._fit(before[go], ids[here][go])
            to = end[here][ok]
            last[to], came[to] = ids[here][ok], at[here][ok]
        return self._walk_back(points, start, size, last, came)

    def _walk_back(self, points, start, size, last, came) -> tuple[np.ndarray, np.ndarray]:
        live = np.arange(len(start))
        at = start + size
        found_unit, found_id, found_point = [], [], []
        while len(live):
            found_unit.append(live)
            found_id.append(last[at])
            found_point.append(points[at - 1])
            at = came[at]
            more = at > start[live]
            live, at = live[more], at[more]
        unit, ids, point = (np.concatenate(x[::-1]) for x in (found_unit, found_id, found_point))
        order = np.argsort(unit, kind="stable")
        unit, ids, point = unit[order], ids[order], point[order]
        lengths = np.ones(len(ids), np.int64)
        foreign = ids < 0
        if foreign.any():
            lengths[foreign] = 1 + (point[foreign] > 0x7F).astype(np.int64) + (point[foreign] > 0x7FF) + (point[foreign] > 0xFFFF)
            raw = np.frombuffer(point[foreign].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            out = np.repeat(ids, lengths)
            out[out < 0] = self.byte[raw]
            ids = out
        return ids, np.bincount(unit, weights=lengths, minlength=len(start)).astype(np.int64)

    def units_of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, each non-empty one after one more space; start, end and row of their units."""
        size = np.diff(at)
        extra = np.cumsum(size > 0)
        out = np.full(len(data) + int(extra[-1]) if len(extra) else 0, 32, np.uint8)
        out[np.arange(len(data)) + np.repeat(extra, size)] = data
        row_at = at + np.concatenate([[0], extra])
        control, space = out < 32, out == 32
        first = np.zeros(len(out), bool)
        first[row_at[:-1][size > 0]] = True
        new = first | control | (space & ~np.concatenate([[False], space[:-1]])) | np.concatenate([[False], control[:-1]])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(out))
        return out, start, end, np.searchsorted(row_at, start, "right") - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's start and end."""
        data, at = text_bytes(texts)
        if MARK.encode() in data.tobytes():
            data, at = text_bytes(pa.array([t and t.replace(MARK, " ") for t in texts.to_pylist()], pa.string()))
        out, start, end, row = self.units_of(data, at)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        _, one, back = np.unique(span_hash(out, start, end), return_index=True, return_inverse=True)
        raw = out.tobytes()
        units = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
        if len(self.seen) + len(units) > MEMORY:
            self.forget()
        new = [u for u in units if u not in self.seen]
        if new:
            ids, lengths = self.encode_units([u.decode("utf-8", "surrogatepass").replace(" ", MARK) for u in new])
            base = len(self.seen)
            self.seen.update(zip(new, range(base, base + len(new))))
            self.flat.append(ids)
            self.lengths.append(lengths)
            if len(self.flat) > 1:
                self.flat, self.lengths = [np.concatenate(self.flat)], [np.concatenate(self.lengths)]
        flat, lengths = self.flat[0], self.lengths[0]
        offset = np.concatenate([[0], np.cumsum(lengths)])
        use = np.array([self.seen[u] for u in units], np.int64)[back]
        size = lengths[use]
        total = np.cumsum(size)
        ids = flat[np.arange(total[-1]) + np.repeat(offset[use] - (total - size), size)]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=len(at) - 1).astype(np.int64))])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids end to end, cut at `at`."""
        begin, size = self.piece_at[ids], self.piece_at[ids + 1] - self.piece_at[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.piece_bytes[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)].tobytes() if len(ids) else b""
        where = total[at]
        texts = [raw[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
        return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


_encoders: dict[str, Encoder] = {}


def _encoder(broadcast, key: str) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*broadcast.value)
    return _encoders[key]


def _encode(broadcast, key: str, names: list[str], check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(broadcast, key)
        for batch in by_bytes(batches, "text"):
            texts = batch.column("text")
            ids, at = encoder.encode(texts)
            gone = texts.is_null()
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=gone if texts.null_count else None)
            cols = [batch.column(c) for c in names] + [lists]
            if check:
                same = [None if t is None else d == t.replace(MARK, " ") for d, t in zip(encoder.decode(ids, at), texts.to_pylist())]
                cols.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, [*names, "ids", *["round_trip"] * check])

    return run


def encode_pieces(docs: DataFrame, path: str = MODEL, check: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids, and with `check` round_trip: whether decoding gives the text back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    out = rows.mapInArrow(_encode(vocabulary, path, ["doc_id"], check), "doc_id long, ids array<int>" + ", round_trip boolean" * check)
    return out.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long")).select("doc_id", "n_pieces", "ids", *["round_trip"] * check)


def _decode(broadcast, key: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(broadcast, key)
        for big in batches:
            for a in range(0, big.num_rows, 500):
                batch = big.slice(a, 500)
                rows = batch.column("ids").to_pylist()
                ids = np.array([i for r in rows for i in r or ()], np.int64)
                at = np.concatenate([[0], np.cumsum([len(r or ()) for r in rows])]).astype(np.int64)
                texts = [None if r is None else t for r, t in zip(rows, encoder.decode(ids, at))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])

    return run


def decode_pieces(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give null."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(vocabulary, path, ["doc_id"]), "doc_id long, text string")
