import re
from itertools import combinations

import pytest

from granary.llm import near_dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {tuple(r) for r in near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()}


def corpus():
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one two"), (204, "ONE\n two"), (205, "one two three"), (206, rows[70][1] + " end"), (207, rows[70][1])]
    return rows


@pytest.mark.parametrize("leaf, depth", [(512, 6), (8, 3)])
def test_like_brute_force(spark, monkeypatch, leaf, depth):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "DEPTH", depth)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 2048 if leaf > 8 else 16)
    rows = corpus()
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("depth", [2, 4])
def test_links_in_crowded_nodes(spark, monkeypatch, depth):
    """Texts that share a long passage crowd the nodes; the links of pairs among them don't depend on the leaders."""
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "DEPTH", depth)
    shared, rows = " ".join(f"w{k}" for k in range(64)), []
    for i in range(40):
        own = " ".join(f"o{i}x{k}" for k in range(60))
        rows += [(2 * i, f"{shared} {own}"), (2 * i + 1, f"{shared} {own} end{i}")]
    want = brute(rows)
    assert len({r[2] for r in want}) == 40 and got(spark, rows) == want


def test_thousands_of_near_copies_and_outsiders(spark, monkeypatch):
    """5,000 copies of a text with one to nine words changed, a tenth of all their links missing, and texts around them."""
    import random

    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(90)], []
    for i in range(5000):
        t = list(base)
        for _ in range(rng.choice((1, 1, 1, 1, 2, 2, 9))):
            t[rng.randrange(90)] = f"x{rng.randrange(40)}"
        rows.append((i + 10, " ".join(t)))
    rows += [(6000 + i, " ".join(f"y{rng.randrange(3000)}" for _ in range(60))) for i in range(300)]
    sets = [shingles(t) for _, t in rows]
    # the same by counting shared shingles of every two documents in a matrix
    import numpy as np

    names = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(rows), len(names)), np.float32)
    for i, s in enumerate(sets):
        has[i, [names[x] for x in s]] = 1
    size, label = has.sum(1), np.arange(len(rows))
    near = np.zeros((len(rows), len(rows)), bool)
    for a in range(0, len(rows), 500):
        both = has[a : a + 500] @ has.T
        near[a : a + 500] = 100 * both >= 75 * (size[a : a + 500, None] + size[None, :] - both)
    for _ in range(50):
        label = np.array([label[near[i]].min() for i in range(len(rows))])
    ids = [i for i, _ in rows]
    want = {(ids[i], len(sets[i]), ids[label[i]], label[i] == i) for i in range(len(rows))}
    groups = np.bincount(label)
    assert groups.max() > 4000 and (groups == 1).sum() > 500  # one large component, and many that stay outside of it
    monkeypatch.setattr(near_dedup, "LEAF", 1024)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 512)
    assert got(spark, rows) == want


def test_recall_just_above_the_threshold(spark):
    """Pairs planted with similarities of 0.75 to 0.80, among texts that share a passage with them."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(2000):
        t = [f"p{i}w{k}" for k in range(200)]
        u = list(t)
        for k in range(0, 5):  # 5 separate changes cost 5 shingles each: 171 of 221 stay
            u[20 + 40 * k] = f"p{i}c{k}"
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(u))]
    found = got(spark, rows)
    assert 0.75 < 171 / 221 < 0.80
    assert sum(r[2] == r[0] - 1 for r in found if r[0] % 2) >= 1999


@pytest.mark.parametrize("least", [1000, 3])
def test_components_of_stars_and_chains(spark, monkeypatch, least):
    """Hubs with small and large ids, chains, and loose edges, with hubs broadcast from four edges on or not at all."""
    from granary.llm import shared

    plain = shared._with_least
    monkeypatch.setattr(shared, "_with_least", lambda edges, hub: plain(edges, min(hub, least)))
    edges = [(5000, i) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(200 + i, 201 + i) for i in range(20)] + [(300, 301), (301, 300), (7, 7), (149, 5001)]
    got = {(r.v, r.root) for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {i: 0 for i in [*range(60), 5000]} | {i: 100 for i in [*range(100, 150), 5001]} | {i: 200 for i in range(200, 221)} | {300: 300, 301: 300}
    assert got == set(root.items())


def test_empty_null_ids_and_extra_columns(spark):
    assert got(spark, []) == set()
    df = spark.createDataFrame([(None, "a b c d e f", 1, 2), (1, "a b c d e f", 3, 4), (1, "a b c d e f", 3, 4)], "doc_id long, text string, kept int, tokens int")
    rows = near_dedup.near_duplicates(df).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 1, True), (1, 1, True), (None, 1, False)]
    out = near_dedup.drop_near_duplicates(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {1}
