"""Corpus preparation: five stages over ``documents``.

Language ID rejects texts without a letter, and those that are no nearer to any
language than chance; exact deduplication keeps the
first of equal texts; the n-gram join keeps one document of each group of near
copies; decontamination drops documents with benchmark passages; what is left
is encoded with SentencePiece, and decoded again to prove it.  Each stage gets
all that the one before kept.  Null and empty texts are rejected by the first
stage; repeated ids, extra columns and empty tables pass through as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuplemill.llm import decontam, exactdedup, langid, ngramjoin, sentencepiece
from tuplemill.llm.common import written
from tuplemill.llm.queries import table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taught = docs.where(docs["doc_id"].isNotNull() & ~langid.held_out())
    return langid.filter_identified(docs, langid.train(taught))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.filter_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The stages' models and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
