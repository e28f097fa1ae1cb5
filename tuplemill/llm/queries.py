"""Queries of the training-data operators, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitpack, decontam, exactdedup, langid, license, ngramjoin, pii, quality, sentencepiece, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; see /opt/tokenizers/README.md."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_table(table(spark, sf_dir, "pages"), min_bytes=0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.token_table(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("span_list")


def queries() -> dict[str, Query]:
    return {
        "op1_language": op1_language,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_decontamination": op3_decontamination,
        "op4_warc": op4_warc,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_quality": op6_quality,
        "op7_ngram_join": op7_ngram_join,
        "op8_token_ids": op8_token_ids,
        "op9_license": op9_license,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": exactdedup.ORACLE,
        "op9_license": license.oracle(),
    }
