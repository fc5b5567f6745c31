"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Every stage takes an empty table to an empty one, keeps columns of its own names out of the way of those of ``docs``,
and reads ``doc_id`` and ``text`` only, but for ``n_chars``, which masking counts anew. What each does with nulls, empty texts and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalloom.llm import decontamination, near_dedup, packing, quality, secret_ledger
from evalloom.llm.queries import tokenizer_file
from evalloom.llm.store import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go: null, empty and very short texts among them. Repeated rows share a verdict; a null id plays no part."""
    return quality.keep_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more.

    The smallest id of a group stays, with all rows that repeat it and its text; rows with a null id or no word all stay.
    """
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in one of twenty words or more go; a null or empty text holds none. Items without words have no windows."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document and every repeated row stays, with its secrets masked; a null text stays null."""
    return secret_ledger.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences; a null or empty text is its end token alone, repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Signatures, tokenizers and packing have no SQL form; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
