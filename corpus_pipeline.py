"""A training corpus from raw documents: quality rules, language ID, near-dedup, PII masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined cases: null and empty texts fail the quality rules. Null labels, languages and sources count as unknown, and a null
source is a queue of its own. Rows with a null or a repeated doc_id are rows of their own in near-dedup, where the one that
stands first in the table stays of each group. Columns besides those of documents pass through all stages but the last,
whatever their names. An empty table gives no pieces. Very long texts are worked on whole, each in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import langid, minhash, packing, pii, quality
from tapeloom.llm.common import fresh, written
from tapeloom.llm.queries import held_out
from tapeloom.llm.tokens import path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words stand mostly in content lines, by a labeller fitted on labelled documents."""
    crf = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, verdict = quality.annotate(docs, crf)
    return out.filter(f"`{verdict}`.kept").drop(verdict)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; what is learned comes from the stage's own input."""
    known = langid.learn(docs.filter(~held_out()))
    out, verdict = langid.annotate(docs, known)
    return out.filter(f"`{verdict}`.kept").drop(verdict)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    If ids are null or repeated they don't name rows; then rows are numbered, and the first row of each group stays."""
    key, rows = "doc_id", docs
    if not docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        key = fresh(docs, "row")
        rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    gone = written(minhash.near_duplicates(rows, key=key).filter("not kept").select(key), "gone")
    if gone.count() <= minhash.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds."""
    out = pii.mask(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, all windows at the mixture of sources of what is left."""
    return packing.pack(docs, path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("pii", pii_masking),
    ("packing", packed),
]

#: SQL can't express the labeller, the compressor or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
