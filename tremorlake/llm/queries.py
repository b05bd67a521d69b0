"""Registered queries of the operators; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import (
    bpe,
    fingerprints,
    html_text,
    importance,
    licenses,
    line_dedup,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    ranked_search,
    token_codes,
    url_filters,
)
from tremorlake.llm.common import scratch
from tremorlake.llm.sql import LICENSES, LINKS, MIX, SEARCH, URLS

RANKS = "byte_bpe_50k.tiktoken"
WORD_PIECES, END_ID = "word_bpe_49k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filters.evaluate(url_filters.captures_of(pages), url_filters.list_of(pages))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), keep=("doc_id", "source"))
    first = F.array_min("positions").alias("first_position")
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", first)
    return rows.orderBy(F.asc_nulls_last("first_position"), "doc_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return left.select("doc_id", "n_lines", "n_removed", F.char_length("text").alias("n_chars_left"), digest)


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_classifier.classify(docs, labels).select("doc_id", "p_text", "p_page", "score", "accepted")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op11_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-codes")
    token_codes.write(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_PIECES), END_ID, path)
    return token_codes.read(spark, path)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_url_filters,
        op3_license_scans,
        op4_mixing,
        op5_line_dedup,
        op6_byte_level_bpe,
        op7_ngram_jaccard_join,
        op8_quality_classifier,
        op9_html_extraction,
        op10_quality_rules,
        op11_token_codes,
        op12_importance_resampling,
        op13_ranked_search,
        pipeline,
    )
}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op2_url_filters": URLS,
    "op3_license_scans": LICENSES,
    "op4_mixing": MIX,
    "op7_ngram_jaccard_join": LINKS,
    "op13_ranked_search": SEARCH,
}
