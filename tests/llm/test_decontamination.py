import random
import re
from collections import Counter

from granary.llm import decontamination


def words(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        seen = set(bag(w)) | {tuple(w[a : a + n]) for n in range(1, 5) for a in range(len(w) - n + 1)}
        for i, x in items:
            y = words(x)
            if not y or not seen & set(bag(y)):
                continue
            best = 0
            for a in range(len(w) - len(y) + 1):
                p, q = bag(w[a : a + len(y)]), bag(y)
                best = max(best, sum((p & q).values()) / sum((p | q).values()))
            if best >= 0.75:
                out[d, i] = round(best, 9)
    return out


def data():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "xa"]) + rng.choice(["", "th", "er", "on", "zu"]) + rng.choice(["", "s", "t"])
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 59)))) for k in range(40)] + [(50, "one two"), (51, ""), (52, None), (53, "just Five words right here"), (54, "aa " * 20)]
    docs = [(0, None), (1, ""), (2, "one"), (3, "well ONE, two!"), (4, "aa " * 30), (5, "just five words right here")]
    for d in range(10, 130):
        w = words(items[rng.randrange(40)][1])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w[: rng.randrange(len(w))]
        docs.append((d, " ".join([word() for _ in range(rng.randint(0, 60))] + [rng.choice([str.upper, str, lambda x: x + "###"])(x) for x in w] + [word() for _ in range(rng.randint(0, 60))])))
    return docs, items


def test_like_brute_force(spark, monkeypatch):
    docs, items = data()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, similarity string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    got = decontamination.find_leaks(d, b)
    rows = got.collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == want and len(want) > 40
    texts, bench = dict(docs), dict(items)
    assert all(len(words(texts[r.doc_id][r.start : r.end])) == len(words(bench[r.item_id])) for r in rows)
    kept = decontamination.drop_leaks(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    monkeypatch.setattr(decontamination, "ITEMS", 10)
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, b).collect()} == set(want)
    assert decontamination.find_leaks(d, b.limit(0)).count() == 0 and decontamination.find_leaks(d.limit(0), b).count() == 0


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for k, n in enumerate([59, 59, 30, 12, 8, 7, 6, 5])] + [(20, "aa " * 20)]
    docs = [(0, "aa " * 17), (1, "aa " * 15), (2, "w1 w2 w3 w4"), (3, None)]
    for k, x in items[:8]:
        w = words(x)
        for cut in (1, 2, 3, 5, 12, 16):
            docs += [(1000 * k + 10 * cut + 5, " ".join(w[cut:])), (1000 * k + 10 * cut + 6, " ".join(w[: len(w) - cut])), (1000 * k + 10 * cut + 7, "# ".join(w[cut // 2 : len(w) - (cut + 1) // 2]))]
        docs += [(1000 * k + 900, " ".join(w[:20] + ["zz"] + w[22:]))]
    want = brute(docs, items)
    for d, t in docs:
        for i, x in items:
            p, q = bag(words(t)), bag(words(x))
            if 5 <= len(words(t)) < len(words(x)) and (share := sum((p & q).values()) / sum((p | q).values())) >= 0.75:
                want[d, i] = round(share, 9)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontamination.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == want and len(want) > 25
    texts, bench = dict(docs), dict(items)
    assert all(words(texts[r.doc_id][r.start : r.end]) == words(texts[r.doc_id]) for r in rows if len(words(texts[r.doc_id])) <= len(words(bench[r.item_id])))


def test_fingerprints_at_the_threshold_stay_within_the_radius():
    """Pairs that are just similar enough, of few and many, plain and repeated shingles."""
    import numpy as np

    rng = np.random.default_rng(8)
    for n in (8, 14, 21, 40, 84):
        for kinds in (n, max(2, n // 4)):
            for _ in range(300):
                a = rng.choice(rng.integers(0, 2**63, kinds, dtype=np.uint64), n)
                b = a.copy()
                b[rng.choice(n, n // 7, replace=False)] = rng.integers(0, 2**63, n // 7, dtype=np.uint64)
                x, y = (decontamination.fingerprints(s, np.zeros(1, np.int64), n)[0] for s in (a, b))
                assert decontamination._ONES[x ^ y].sum() <= decontamination.RADIUS


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(30))
    d = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "x " + text * 1)], "doc_id long, text string")
    b = spark.createDataFrame([(7, text), (7, text)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontamination.find_leaks(d, b).collect()) == sorted(["1"] * 4 + ["None"] * 2 + ["2"] * 2)
    assert decontamination.find_leaks(d.limit(0), b).count() == 0 and decontamination.find_leaks(d, b.limit(0)).count() == 0
