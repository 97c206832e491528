"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import (
    byte_bpe,
    decontaminate,
    hard_negatives,
    html_extract,
    language_id,
    licenses,
    media,
    mixing,
    ngram_join,
    oracles,
    substring_dedup,
    token_alignment,
    token_records,
    url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return ngram_join.ngram_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as chunks, read back and described."""
    return media.store_and_read(_table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from its record."""
    return token_records.token_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that they overlap."""
    found = decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_places", F.col("matched").cast("long").alias("matched"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents state."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that an earlier document has."""
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the ranks of a vocabulary and decoded again."""
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each positive of the anchors."""
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment between two tokenizers, and how its links stand in the corpus."""
    return token_alignment.alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_jaccard_join, op2_html_extraction, op3_url_filter, op4_language_id, op5_source_mixing,
        op6_media_columns, op7_token_records, op8_decontamination, op9_license_scan, op10_substring_dedup,
        op11_byte_bpe, op12_hard_negatives, op13_token_alignment,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": oracles.OP1,
        "op3_url_filter": oracles.op3(),
        "op5_source_mixing": oracles.OP5,
        "op8_decontamination": oracles.OP8,
        "op9_license_scan": oracles.op9(),
        "op10_substring_dedup": oracles.OP10,
        "op12_hard_negatives": oracles.OP12,
    }
