"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame; ``run`` writes each stage's rows as Parquet to the shared folder and
rereads them as the next one's ``docs``, so a lost executor never replays earlier stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientlens.llm import bpe, exact_dedup, mixing, partenum, quality_rules
from clientlens.llm.common import documents, shared_table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard of 0.8 or more)."""
    return partenum.keep(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, a row per occurrence of a document."""
    return mixing.curriculum(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per occurrence: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, bpe.default_ranks(spark))


STAGES = [
    ("quality rules", rules_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mix_stage),
    ("byte-level BPE", encode_stage),
]

#: SQL cannot express the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
