"""The registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, embeddings, langid, minhash, ngrams, packing, pii, quality, sampling, warc
from .common import scratch
from .tokens import path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = quality.fit(docs, table(spark, sf_dir, "labels"))
    out, name = quality.annotate(docs.select("doc_id", "text"), crf)
    return out.select("doc_id", f"{name}.*")


def held_out() -> F.Column:
    """Documents that language identification doesn't learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    known = langid.learn(docs.filter("not held_out"))
    out, name = langid.annotate(docs.select("doc_id", "held_out", "text"), known)
    return out.select("doc_id", "held_out", f"{name}.lang_pred", f"{name}.score", f"{name}.margin", F.col(f"{name}.kept").alias("confident"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngrams.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), F.round("mean_log", 7).alias("mean_log"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", F.col(name).alias("found"))
    counts = [pii.count(F.col("found"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("found"), pii.BASE_KINDS), 256).alias("base_sha256"), pii.joined(F.col("found"), pii.KINDS).alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy, to = scratch(spark, "legacy"), scratch(spark, "archives")
    warc.archive(table(spark, sf_dir, "pages"), legacy)
    warc.convert(spark.read.parquet(legacy), to)
    return warc.read(spark, to).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.segmentations(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "codes")
    dac.write(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), to)
    return dac.read(spark, to)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_scores": op2_lm_scores,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_pii": op4_pii,
    "op5_warc": op5_warc,
    "op6_sampled_segmentations": op6_sampled_segmentations,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_token_codes": op10_token_codes,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components of links(a, b) over ids(id): the smallest id that each reaches.
_REACHED = """
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (
    SELECT id, id FROM ids
    UNION
    SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other
),
reached AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

ORACLES: dict[str, str] = {
    "op2_lm_scores": rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
tokens AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM texts),
ones AS (SELECT x, count(*) AS n FROM tokens GROUP BY 1),
corpus AS (SELECT sum(n) AS t FROM ones),
pairs AS (SELECT a.r, a.x, b.x AS y, count(*) AS own FROM tokens a JOIN tokens b ON a.r = b.r AND b.i = a.i + 1 GROUP BY ALL),
twos AS (SELECT x, y, sum(own) AS n FROM pairs GROUP BY ALL),
terms AS (
    SELECT r, ln(n / t) AS s FROM tokens JOIN ones USING (x), corpus WHERE i = 0
    UNION ALL
    SELECT r, own * CASE WHEN twos.n > own THEN ln(twos.n / a.n) ELSE ln(0.4 * b.n / t) END
    FROM pairs JOIN twos USING (x, y) JOIN ones a USING (x) JOIN ones b ON b.x = pairs.y, corpus
),
sums AS (SELECT r, sum(s) AS s FROM terms GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 5) AS log_score, CASE WHEN len(w) > 0 THEN round(s / len(w), 7) END AS mean_log
FROM texts LEFT JOIN sums USING (r)
""",
    "op3_embedding_dedup": f"""
WITH RECURSIVE wide AS (
    SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
),
usable AS (
    SELECT id, label, x FROM wide
    WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0
        AND len(list_filter(x, lambda v: v <> 0)) > 0
),
links AS (
    SELECT u.id AS a, v.id AS b FROM usable u JOIN usable v
        ON u.label = v.label AND len(u.x) = len(v.x) AND u.id <> v.id AND list_cosine_similarity(u.x, v.x) >= 0.93
),
ids AS (SELECT id FROM wide),
{_REACHED},
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM reached LEFT JOIN counted ON a = id
""",
    "op5_warc": """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM firsts
""",
    "op7_minhash_dedup": rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words
),
marks AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
    FROM marks a JOIN marks b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
ids AS (SELECT doc_id AS id FROM documents),
{_REACHED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN reached ON doc_id = id
""",
}
