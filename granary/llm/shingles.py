"""Words and word shingles of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

from granary.llm.shared import mix

_rng = np.random.default_rng(20240229)
#: A random value for each byte, and the odd base of the polynomial that hashes words.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word `[^\\x20\\x09-\\x0D]+`; A-Z count as a-z if `lower`. No word crosses a row."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    full = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = full[:-1]
    start = np.flatnonzero(full & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = full[1:]
    end = np.flatnonzero(full & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row, span_hash(LOWER[data] if lower else data, start, end)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, equal for equal bytes."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _power("up", BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * _power("down", BASE_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every `size`-word shingle; a row of fewer words gives one shingle, its whole sequence."""
    n = len(hashes)
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total += hashes[k : n - size + 1 + k] * _STEP[k]
        ok = row[: n - size + 1] == row[size - 1 :]
        out, of = mix(total[ok]), row[: n - size + 1][ok]
    count = np.bincount(row, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(row, short)
        sums = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            sums[has] += hashes[first[has] + k] * _STEP[k]
        out = np.concatenate([out, mix(sums ^ (count[short].astype(np.uint64) << np.uint64(57)))])
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def row_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct shingle hashes."""
    n_rows = len(offsets) - 1
    _, _, row, hashes = words(data, offsets)
    out, of = shingle_hashes(hashes, row, n_rows, size)
    cut = np.searchsorted(of, np.arange(n_rows + 1))
    return [np.unique(out[cut[i] : cut[i + 1]]) for i in range(n_rows)]
