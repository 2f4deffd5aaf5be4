"""A corpus pipeline: every stage reads what its predecessor kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dualcheck.llm import stages
from dualcheck.session import materialize

#: (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_strings", stages.repeated_strings),
    ("live_secrets", stages.live_secrets),
    ("packing", stages.packing),
]

#: SQL can't express tokenisation, so the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each returns is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
