"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import embeddings, exact, html_text, importance, jaccard, line_dedup, mixing, phrases, pieces, quality, suffixes, urls, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample_pieces_digest(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_rules(pages, urls.contract_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources_digest(_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_digest(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines_digest(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup_digest(_table(spark, sf_dir, "documents"))


def op11_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies_digest(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations_digest(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_near_vectors,
    op2_ngram_jaccard,
    op3_sample_pieces,
    op4_suffix_dedup,
    op5_url_filters,
    op6_mix_sources,
    op7_html_text,
    op8_warc,
    op9_quality_rules,
    op10_line_dedup,
    op11_importance_sample,
    op12_exact_copies,
    op13_collocations,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_vectors": embeddings.ORACLE,
        "op2_ngram_jaccard": jaccard.ORACLE,
        "op4_suffix_dedup": suffixes.ORACLE,
        "op5_url_filters": urls.ORACLE,
        "op6_mix_sources": mixing.ORACLE,
        "op8_warc": warc.ORACLE,
        "op9_quality_rules": quality.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op11_importance_sample": importance.ORACLE,
        "op12_exact_copies": exact.ORACLE,
        "op13_collocations": phrases.ORACLE,
    }
