"""The queries op1 to op10 with production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import _common as C
from . import decontaminate, langid, line_dedup, near_dup, ordinal_quality, piece_lattice, quality_rules, secret_scan, token_store, warc


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.report(C.load(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(C.load(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.report(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(C.load(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(C.load(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(C.load(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(C.load(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(C.load(spark, sf_dir, "pages"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(C.load(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return token_store.read_tokens(manifest, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_sentencepiece, op3_secret_scan, op4_quality_classifier, op5_language_id, op6_quality_rules, op7_line_dedup, op8_near_dedup, op9_warc, op10_token_store)
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.REPORT_SQL,
    "op6_quality_rules": quality_rules.REPORT_SQL,
    "op9_warc": warc.ARCHIVE_SQL,
}
