"""Stages of the corpus pipeline: each applies one operator to whole documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, secret_scan, simhash, suffix_dedup, vector_packing
from .queries import MULTI, PIECE, WORD_BPE, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base counts or lie outside their language's bands go."""
    return fertility.keep_good(docs, vocabulary(PIECE), vocabulary(MULTI))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start more than once go from all texts; every document stays."""
    return suffix_dedup.without_repeats(docs)


def live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials of few owners are masked; copied examples and every document stay."""
    name = "repo" if "repo" not in docs.columns else "__repo"
    marked = docs.withColumn(name, F.when(F.col("source").isNotNull(), F.concat_ws("/", "source", "lang")))
    return secret_scan.redacted(marked, repo_col=name).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in training sequences of 2,048 tokens, with their token ids."""
    out = vector_packing.pack(docs, vocabulary(WORD_BPE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids")
