"""Registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import chat, jaccard, language, mixing, mpeg, packing, pii, quality, secrets, warc
from skein.llm.sql import SQL
from skein.sources.tables import table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' files are; every executor has them installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii.trained(spark))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat.as_log(chat.probe(table(spark, sf_dir, "conversations")))
    return chat.report(chat.format_log(log))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.write(table(spark, sf_dir, "pages")))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.features(mpeg.store(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_pii, op3_jaccard_join, op4_mixing, op5_secret_scans, op6_chat, op7_packing, op8_language, op9_mpeg_audio, op10_warc_zip)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
