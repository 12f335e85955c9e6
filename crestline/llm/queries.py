"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, jaccard, lines, lm_score, mixing, packing, passages, quality, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), labels)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated and shuffled so that all sources have the same expected share."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 6))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, for four-word shingles and a similarity of 0.85."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, num=85, den=100)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the cleaned text's hash of every document; recurring lines of every length go."""
    cleaned = lines.clean_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule, verdict and posterior of every document."""
    return quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))


URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return urls.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and maximum-entropy scores of every document."""
    return lm_score.lm_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat an earlier document's, in words: one row each."""
    found = passages.repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "start", "words", F.col("source_id").alias("source_doc_id"), "source_start", "source_words", "matches"
    )


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS rn FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mixing": op2_mixing,
        "op3_packing": op3_packing,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality": op7_quality,
        "op8_url_filter": op8_url_filter,
        "op9_lm_score": op9_lm_score,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.oracle_sql(), "op5_exact_dedup": OP5_SQL, "op6_line_dedup": lines.oracle_sql()}
