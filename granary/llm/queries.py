"""The queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, html, language, licenses, near_dedup, pieces, quality, secrets, sharding, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_bytes(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["at"].cast("string"), x["to"].cast("string"))), ",")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") == 0).alias("kept"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), text.alias("spans"), "n_shared_passages")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), text.alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_license_scans": op10_license_scans,
}

#: Words of a text as the contracts define them, on lower-cased A-Z.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i+4], ' '))) AS shingle FROM w WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT links.b, reach.r FROM reach JOIN links ON reach.v = links.a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.r) AS component_id, d.doc_id = min(reach.r) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.v = d.doc_id GROUP BY d.doc_id, n.n
    """,
    "op3_sharding": rf"""
        WITH RECURSIVE shard AS (
            SELECT k, ('0x' || substr(md5('shard-' || lpad(k::VARCHAR, 5, '0') || '/offset'), 1, 8))::BIGINT % {sharding.SIZE} AS off,
                ('0x' || substr(md5('shard-' || lpad(k::VARCHAR, 5, '0') || '/skip'), 1, 8))::BIGINT % ({sharding.SIZE} - 1) + 1 AS skip
            FROM range({sharding.SHARDS}) t(k)),
        -- each claim: the turn, the slot taken, and the free slots after it as one 0/1 string
        claims AS (
            SELECT -1 AS turn, -1 AS slot, repeat('0', {sharding.SIZE}) AS taken
            UNION ALL
            SELECT turn, slot, left(taken, slot) || '1' || substr(taken, slot + 2) FROM (
                SELECT c.turn + 1 AS turn, c.taken,
                    list_filter(list_transform(range({sharding.SIZE}), lambda i: (s.off + i * s.skip) % {sharding.SIZE}), lambda x: c.taken[x + 1] = '0')[1] AS slot
                FROM claims c JOIN shard s ON s.k = (c.turn + 1) % {sharding.SHARDS} WHERE c.turn + 1 < {sharding.SIZE}))
        SELECT d.doc_id, c.slot::INT AS slot, (c.turn % {sharding.SHARDS})::INT AS shard
        FROM documents d LEFT JOIN claims c ON c.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % {sharding.SIZE}
    """,
    "op6_quality_rules": rf"""
        WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
        rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, range(8) r(j) GROUP BY doc_id),
        l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM t),
        lw AS (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM l),
        real AS (SELECT doc_id, source, text, line, array_to_string(words, ' ') AS norm, len(words) AS n FROM lw WHERE len(words) > 0),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM real GROUP BY doc_id),
        hosts AS (SELECT source, count(DISTINCT text) AS host_docs FROM t GROUP BY source),
        freq AS (SELECT r.source, norm FROM (SELECT source, norm, count(DISTINCT text) AS docs FROM real GROUP BY 1, 2) r JOIN hosts h ON h.source IS NOT DISTINCT FROM r.source
            WHERE docs > {quality.LINE_DOCS} AND docs > host_docs * {quality.LINE_SHARE}),
        gone AS (SELECT r.doc_id, sum(n) AS removed_words FROM real r JOIN freq f ON f.source IS NOT DISTINCT FROM r.source AND f.norm = r.norm GROUP BY r.doc_id),
        f AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
            FROM t LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
        SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
            NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words) AND removed_words <= {quality.DEPLETED} * n_words AS kept FROM f
    """,
}
