"""The queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, filter_audit, licenses, media, ngram_join, packing, quality_rules, secrets, sentence_pieces, spelling, token_counts, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return url_filter.url_verdicts(pages, url_filter.outcomes_of(pages, labels))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_packing": op2_packing,
        "op3_sentence_pieces": op3_sentence_pieces,
        "op4_token_counts": op4_token_counts,
        "op5_ngram_join": op5_ngram_join,
        "op6_secret_scans": op6_secret_scans,
        "op7_media_columns": op7_media_columns,
        "op8_url_filters": op8_url_filters,
        "op9_license_scans": op9_license_scans,
        "op10_toxicity": op10_toxicity,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_filter_audit": op12_filter_audit,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
            h AS (SELECT doc_id, sha256(x) AS text_sha256 FROM t)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM h WINDOW w AS (PARTITION BY text_sha256)""",
        "op5_ngram_join": ngram_join.ORACLE_SQL,
        "op6_secret_scans": secrets.ORACLE_SQL,
        "op8_url_filters": url_filter.ORACLE_SQL,
        "op11_spelling_variants": spelling.ORACLE_SQL,
        "op12_filter_audit": filter_audit.ORACLE_SQL,
        "op13_quality_rules": quality_rules.ORACLE_SQL,
    }
