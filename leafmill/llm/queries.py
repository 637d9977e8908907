"""One query for each operator, over its whole table, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import host_rules, language_id, licenses, media_archive, mixing, near_dedup, packing, substring_dedup, token_output, url_filter
from .common import documents


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir).select("doc_id", "text"), report=True)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op3, on pages with planted canonical links: there the components decide."""
    pages = url_filter.planted_links(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return url_filter.url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.host_rules(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.token_output(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_archive.media_columns(documents(spark, sf_dir).select("doc_id", "text"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir).select("doc_id", "text", "source"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_host_rules": op4_host_rules,
    "op5_language_id": op5_language_id,
    "op6_token_output": op6_token_output,
    "op7_license_scan": op7_license_scan,
    "op8_media_columns": op8_media_columns,
    "op9_near_dedup": op9_near_dedup,
    "op10_packing": op10_packing,
    "url_aliases": url_aliases,
}

ORACLE_SQL = {
    "op1_source_mixing": mixing.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op4_host_rules": host_rules.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "url_aliases": url_filter.PLANTED_ORACLE,
}
