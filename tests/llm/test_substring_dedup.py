import hashlib
import random
import re

import numpy as np
import pytest

from granary.llm import substring_dedup as sd


def brute(texts, length):
    """Removed bytes by a dictionary of all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for a in range(len(r) - length + 1):
            seen[r[a : a + length]] = seen.get(r[a : a + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for a in range(len(r) - length + 1):
            if seen[r[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(rng.choice([380, 400, 450, 900, 1500])) for _ in range(6)]
    texts = [None, "", "short", "a" * 399, "b" * 400, "b" * 401, "c" * 2000, "xyz" * 400, "\0" * 700]
    for _ in range(60):
        parts = [text(rng.randint(0, 700))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + "X" + p[k + 1 :]
            parts += [p[rng.choice([0, 0, 37]) :], text(rng.randint(0, 500))]
        texts.append("".join(parts))
    same = text(3000)
    texts += [same, same, same[:1700] + "!" + same[1700:], texts[20]]
    return texts


@pytest.mark.parametrize("hot", [4096, 3])
def test_like_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, sha string")
    got = sd.repeated_bytes(df).collect()
    want = brute(texts, sd.LENGTH)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert sum(s.to - s.at for s in r.spans) == r.n_removed
    assert sd.repeated_bytes(df.limit(0)).count() == 0


def test_matching_statistics_like_brute_force():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    groups = sorted(rng.randrange(5) for _ in texts)
    best, start, runs = sd.matching_statistics(texts, groups)
    places = [(k, a) for k, t in enumerate(texts) for a in range(len(t))]
    for k, a in places:
        longest = 0
        for j, b in places:
            if groups[j] == groups[k] and (j, b) != (k, a):
                x, y = texts[k][a:], texts[j][b:]
                longest = max(longest, next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y))))
        assert best[start[k] + a] == longest
    repetitive = [b"abcdefghij" * 50] * 20
    assert sd.matching_statistics(repetitive, [0] * 20)[2] < 20 * 500 / 8


def test_every_window_has_its_smallest_run():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(3000)), np.uint8)
    at, h = sd.anchors(data)
    every = sd.window_hashes(data, sd.ANCHOR)
    for a in range(len(data) - sd.LENGTH + 1):
        w = every[a : a + sd.LENGTH - sd.ANCHOR + 1]
        assert a + int(w.argmin()) in at
    assert len(at) < 0.03 * len(data)


def test_hot_anchors_are_split_until_windows_meet(spark, monkeypatch):
    """Many texts hold one passage with different bytes around and inside of it; every split gives the marks of brute force."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, left, right, texts = text(sd.ANCHOR), text(300), text(300), []
    for i in range(60):
        a, b = rng.randrange(0, 301), rng.randrange(0, 301)
        texts.append(text(rng.randint(0, 250)) + left[300 - a :] + core + right[:b] + text(rng.randint(0, 250)))
    texts += ["q" * 5000, "xy" * 900 + core + right, "q" * 5001]
    monkeypatch.setattr(sd, "HOT", 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts, sd.LENGTH)
    assert 0 < sum(w[1] for w in want[:60]) < sum(w[0] for w in want[:60])
    for r in sd.repeated_bytes(df).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_periodic_text_is_one_entry():
    at, h = sd.anchors(np.frombuffer(b"c" * 100_000, np.uint8))
    first, last, _ = sd.stretches(at, h)
    assert len(at) > 50_000 and len(first) == 1 and last[0] == at.max() and first[0] == at.min()


def test_query_columns(spark, tmp_path):
    from granary.llm.queries import op8_suffix_dedup

    spark.createDataFrame([(1, "ab" * 300), (2, "clean text"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert (got[1].kept, got[1].n_kept, got[1].spans) == (False, 0, "0:600")
    assert (got[2].kept, got[2].n_kept, got[2].spans) == (True, 10, "") and got[3].n_kept == 0


def test_a_shared_passage_of_over_fifty_words_goes_if_it_has_400_bytes(spark, tmp_path):
    from granary.llm.queries import op8_suffix_dedup

    rng = random.Random(4)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefgh") for _ in range(size)) for _ in range(n))
    long, short = words(55, 8), words(55, 5)
    texts = [words(80, 7) + "\n" + p + "\n" + words(80, 7) for p in (long, long, short, short)] + [words(200, 7)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(short) < sd.LENGTH < len(long)
    assert [got[k].kept for k in range(5)] == [False, False, True, True, True]
    assert all(got[k].n_removed >= len(long) for k in (0, 1)) and all(got[k].n_kept == len(texts[k]) for k in (2, 3, 4))


def shared_passages(texts):
    """Windows of 51 words that another text holds too, by a dictionary of all windows."""
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    holders = {}
    for k, w in enumerate(split):
        for a in range(len(w) - 50):
            holders.setdefault(tuple(w[a : a + 51]), set()).add(k)
    return [sum(len(holders[tuple(w[a : a + 51])]) > 1 for a in range(len(w) - 50)) for w in split]


def test_documents_that_share_over_fifty_words(spark, tmp_path):
    from granary.llm.queries import op8_suffix_dedup

    rng = random.Random(6)
    words = lambda n, size=5: " ".join("".join(rng.choice("abcdefgé") for _ in range(size)) for _ in range(n))
    passage, fifty, twice = words(51), words(50), words(60)
    texts = [None, "", passage, words(80) + "\n" + passage + "\n" + words(80), words(30) + "\t" + passage.replace(" ", "\r\n") + " " + words(9)]
    texts += [words(80) + " " + fifty + " " + words(80) for _ in range(2)] + [words(20) + " " + twice + " " + words(20) + " " + twice, words(200), passage.upper()]
    same, tiny = words(70), words(51, 1)
    texts += [same, same, words(3), words(50), tiny + " " + words(9), words(9) + " " + tiny, "er " * 4000, "er " * 51, "er " * 50, "er\n" * 300 + words(60)]
    texts += [words(5) + " " + same[100:] + " " + words(5), words(60) + "\u00a0" + passage]
    pool = [words(rng.choice([49, 50, 51, 52, 70, 150])) for _ in range(8)]
    texts += [" ".join(x for _ in range(3) for x in (words(rng.randint(0, 40)), rng.choice(pool)[rng.choice([0, 0, 0, 6, 60]) :])) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(passage.encode()) < sd.LENGTH and [got[k].n_removed for k in (2, 3, 4)] == [0, 0, 0]
    assert [got[k].n_shared_passages for k in range(10)] == [0, 0, 1, 1, 1, 0, 0, 0, 0, 0]
    assert [got[k].n_shared_passages for k in range(len(texts))] == shared_passages(texts)


def test_suffix_order_like_plain_doubling():
    """Only suffixes that others equal so far are sorted on; order and equal ranks are those of sorting all each time."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(20)] + [b"ab" * 90, b"a" * 130]
    text = np.array([c for t in texts for c in (*(x + 1 for x in t), 0)], np.uint16)
    group = np.repeat(np.arange(len(texts)) // 3, [len(t) + 1 for t in texts])
    n, width = len(text), 4
    key = [(int(group[a]), *text[a : a + 4].tolist()) for a in range(n)]
    order, ranks = sd.suffix_order(text, group)
    for got_width, got in ranks:
        dense = {k: i for i, k in enumerate(sorted(set(key)))}
        rank = [dense[k] for k in key]
        assert got_width == width and [rank.index(r) for r in rank] == [got.tolist().index(r) for r in got.tolist()]
        key = [(r, rank[a + width] + 1 if a + width < n else 0) for a, r in enumerate(rank)]
        width *= 2
    assert len(set(rank)) == n and order.tolist() == sorted(range(n), key=rank.__getitem__)
