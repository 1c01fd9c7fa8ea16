"""The pipeline against its stages in plain Python, at the smallest size."""

import sentencepiece

import corpus_pipeline
from granary.llm import pieces, secrets
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_dedup import brute as classes
from tests.llm.test_scans import plain_quality

SF = "/root/testdata/sf0.001"


def test_like_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = {r[0] for r in plain_quality([(i, r.text, r.source) for i, r in rows.items()]) if r[-1]}
    left = {r[0] for r in classes([(i, rows[i].text) for i in left]) if r[3]}
    left -= {d for d, _ in leaks([(i, rows[i].text) for i in left], items)}
    model = secrets.train(docs.where(docs.doc_id.isin(sorted(left))))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {}
    for i in left:
        text, parts, last = rows[i].text, [], 0
        for a, b, _ in secrets.scan_texts([text], model)[0]:
            if a >= last:
                parts += [text[last:a], secrets.REPLACEMENT]
            last = max(last, b)
        want[i] = library.encode("".join(parts) + text[last:])
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(want) > 100
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.encode(spark, docs, SF).count() == 0
