"""From raw documents to token ids in five stages; each is written as Parquet and read again as the next one's documents.

Counted as part of ``gridloom.llm``: if that subpackage is deleted, this file goes with it.

Defined results: documents with a null or blank text, or of fewer than 20 words, go in the first stage; those
without a host are judged by their own rules only; in the second those without a letter or of no learned
language; in the third all but one row of each group of copies and near copies, repeated rows included (that
with the smallest doc_id stays; one without a doc_id only if the group has no other); in the fourth those that
are mostly benchmark passages, and the passages of others. Texts of any length are read whole. Other columns,
whatever their names, come through the first four stages as they were; n_chars follows a text that is cut. No
documents give an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, language, quality, simhash
from gridloom.llm.common import drop, fresh_path, staging, table

#: Not expressible in SQL: fingerprints, hyperdimensional vectors and byte-pair merges.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule and whose host isn't rejected."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language, learned from the labels of what is left."""
    return language.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints and of texts similar in 0.8 of their five-word shingles."""
    return simhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether they decode to the text."""
    return bpe.encoded(docs, keep=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop(spark, last)
        last = path
    return docs
