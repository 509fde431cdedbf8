"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .decontaminate import ORACLE as DECONTAMINATION_SQL


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .iso_media import store_texts

    return store_texts(table(spark, sf_dir, "documents"), with_media=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    return identify(docs, docs.where(~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13, share=20)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, bits=2)


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent_lm import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), capacity=4096)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_suffixes

    return dedup_suffixes(table(spark, sf_dir, "documents"), window=100, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    labels = table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    return score_toxicity(table(spark, sf_dir, "documents"), labels.where(~out), threshold=0.3).select("doc_id", out.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_language_id, op3_substring_dedup, op4_benchmark_decontamination, op5_simhash_near_dedup, op6_maxent_lm, op7_html_extraction, op8_best_fit_packing, op9_suffix_array_dedup, op10_toxicity)}
ORACLE_SQL: dict[str, str] = {"op4_benchmark_decontamination": DECONTAMINATION_SQL}
