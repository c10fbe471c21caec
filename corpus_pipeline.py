"""From raw documents to token counts: reject low quality, drop near-duplicates and benchmark leaks, redact secrets, encode.

Every stage takes any table with doc_id and text (more columns pass through all but the last stage, whatever their names),
gives an empty table for an empty one, and reads whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridindex.llm import bpe, decontaminate, minhash, quality, secret_scan
from gridindex.llm.queries import _tokenizer
from gridindex.llm.ranges import checkpointed
from gridindex.shared import removed, temporary

#: Trained models decide in some stages, so SQL can't give these rows; the tests compare them with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    Null and empty texts and null metadata are scored like any other value; repeated rows stay or go together; rows with a
    null doc_id are unlabelled. Without labels of both classes all rows stay.
    """
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles, similarity 0.8; of ties the least doc_id.

    Null and empty texts are nobody's duplicates and stay, as do rows with a null doc_id; of rows that share a doc_id one stays.
    """
    return minhash.deduplicated(spark, docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay, as do all rows where the benchmark is empty; repeated rows stay or go together.
    """
    return decontaminate.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows.

    Null texts stay null; repeated rows stay repeated.
    """
    return secret_scan.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents: a row each, repeated rows included; a null text is an empty one."""
    return bpe.encode_documents(spark, docs, _tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; only the last one's table stays there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporary(spark) as paths:  # a stage's own tables go when its result is written
            out = checkpointed(spark, stage(spark, docs, sf_dir), f"pipeline_{name}")
            paths.pop()  # the result
        if before is not None:
            removed(spark, before)
        docs = before = out
    return docs
