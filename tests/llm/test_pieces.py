import pyarrow as pa
import pytest
import sentencepiece

from granary.llm import pieces

TEXTS = [None, "", " ", "  ", "a", "a  b", " a ", "a\nb\tc\r\n", "▁x▁", "é́ ﬁ", "<s> x </s> <unk> <0x41>", "日本\U0001f600語", "\x00a\x7f", "word" * 3000, "x" * 500 + " " * 40 + "y", "Ünïcödé ✓ 𝔘𝔫𝔦", "the the the", "#### //// ====", "\U0001f600" * 5 + "é"]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(*pieces.load_vocabulary())


def test_like_the_public_library(encoder):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    import duckdb

    texts = TEXTS + [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "")
    assert encoder.decode(ids, at) == [(t or "").replace("▁", " ") for t in texts]


def test_occurrences_are_all_edges(encoder):
    import numpy as np

    text = "▁the▁rain"
    letters = np.append(encoder.letter[[ord(c) for c in text]], 0).astype(np.uint16)
    at, piece = encoder._edges(letters)
    got = {(int(a), encoder.pieces[encoder.ids[p]]) for a, p in zip(at, piece)}
    assert got == {(i, text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in encoder.id_of}


def test_memory_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 3)
    for t in ("a b c d e f", "g h i", "a g z"):
        ids, at = encoder.encode(pa.array([t]))
        assert encoder.decode(ids, at) == [t]


def test_round_trip_in_spark(spark):
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in enumerate(TEXTS)] + [(None, "tail", None, None), (3, "  ", None, None)], "doc_id long, text string, ids array<int>, n_pieces string")
    out = pieces.encode_pieces(df)
    assert out.columns == ["doc_id", "n_pieces", "ids", "round_trip"]
    rows = out.collect()
    assert all(r.round_trip for r in rows if r.ids is not None) and [r.n_pieces for r in rows[:2]] == [0, 0] and rows[0].ids is None and rows[0].round_trip is None
    back = {(r.doc_id, r.text) for r in pieces.decode_pieces(out).collect()}
    assert back == {(i, None if t is None else t.replace("▁", " ")) for i, t in enumerate(TEXTS)} | {(None, "tail")}
    assert pieces.encode_pieces(df.limit(0)).count() == 0
