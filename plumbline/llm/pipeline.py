"""The corpus pipeline: documents in, digests of their token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All
but the last return the columns of ``documents``. Rows are told apart by doc_id and text,
so that a decision about one text never falls on another of the same doc_id; rows equal in
both are one document. A null doc_id is an id like any other, after all others in rank; a
null text counts as empty. Columns beyond those of ``documents`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, langid, simhash, substrings
from plumbline.shared import new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text's language is identified stay; null, empty and letterless texts go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the lowest doc_id stays, of one doc_id the text of the lowest hash; rows equal in both stay together."""
    return simhash.keep_first(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages and lines that an earlier document has. All rows stay, those without a doc_id as they are; rows of one doc_id lose nothing to one another."""
    return substrings.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; null and empty texts hold none."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's byte-level BPE ids; a null text has none."""
    return bpe.encode_digests(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("line_dedup", line_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: The stages learn, link and encode in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
