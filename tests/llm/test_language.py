import math
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from granary.llm import language


def clean(text):
    return bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode())


def plain_bits(samples, text):
    """PPM code length by walking the trees byte by byte."""
    seen = Counter()
    for s in samples:
        b = b" " * language.ORDER + clean(s)
        for i in range(language.ORDER, len(b)):
            for k in range(language.ORDER + 1):
                seen[b[i - k : i], b[i]] += 1
    followers = {}
    for (ctx, c), n in seen.items():
        followers.setdefault(ctx, {})[c] = n
    total, b = 0.0, b" " * language.ORDER + clean(text)
    for i in range(language.ORDER, len(b)):
        for k in range(language.ORDER, -1, -1):
            f = followers.get(b[i - k : i])
            if not f:
                continue
            t, d = sum(f.values()), len(f)
            if b[i] in f:
                total -= math.log2(f[b[i]] / (t + d))
                break
            total -= math.log2(d / (t + d))
        else:
            total += 8
    return total


SAMPLES = {"x": ["the cat and the dog", "The end. É"], "y": ["der hund und die katze ß", "ein ende"]}


def test_code_lengths_like_plain_walk():
    trees = language.Trees(SAMPLES)
    texts = ["the hund", "", "Zürich 12 q", "cat and katze", "É", "z"]
    got = trees.lengths(pa.array(texts))
    for i, t in enumerate(texts):
        for j, name in enumerate(trees.names):
            assert got[i, j] == pytest.approx(plain_bits(SAMPLES[name], t), abs=1e-3)


def test_edges(spark):
    rows = [(0, None, "x"), (1, "", "x"), (2, "12 34 !", "x"), (3, "the cat", "x"), (3, "the cat", "x"), (None, "die katze", "y"), (6, "die katze", "y"), (7, "ß", None), (8, "中", "x")] + [(10 + i, "die katze und", "y") for i in range(6)]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0
    for i in got:
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
    assert got[6].lang_pred == "y" and got[None].lang_pred == "y" and got[7].lang_pred != "und" and got[8].lang_pred != "und"
    assert language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", df.lang.substr(100, 1)).where("false").unionByName(df.selectExpr("doc_id", "text", "cast(null as string) lang", "score", "lang_pred"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 250 and right >= 0.95 * len(got)
    print(right, len(got))
