"""A corpus from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next.  All
stages but the last return the columns of ``documents``.  When a stage begins, the
intermediate tables of the stages before it are removed, but for those that its ``docs``
still read (of a stage that was not written).  So one run ends before another begins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crestline.llm import exact_dedup, jaccard, mixing, packing, toxicity
from crestline.llm.queries import tokenizer_path
from crestline.llm.store import cut, drop_unread, made_here

_made: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _made[:] = drop_unread(_made, docs)
        with made_here(_made):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity is 0.5 or more; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(toxicity.fold("doc_id", 5) != 0))
    if not model.n_rows:
        return docs
    scored = toxicity.score(docs, model, score_col="__toxic")
    return scored.where("__toxic < 0.5").select(*docs.columns)


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return jaccard.drop_near_duplicates(docs, k=5, num=80, den=100)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources have the same expected share of characters."""
    return mixing.mix_sources(docs).select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokens and learnt scores are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = cut(f(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
