"""Disagreement scores and flags (C1-C6) and the arbiter work list (V1)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions.fields import by_field, fence, fenced_filter
from ..spec import Schema


def score(df: DataFrame, schema: Schema) -> DataFrame:
    """Adds ``score``: 1.0 for a suspicious empty side, else graded disagreement.

    Needs ``con``/``unc`` and their canonical texts ``con_n``/``unc_n``.
    """
    return fence(df.withColumn("score", by_field(schema, lambda s: C.flag_score(
        s, F.col("con_c"), F.col("unc_c"), F.col("con_key"), F.col("unc_key")))))


def disagreement(df: DataFrame, schema: Schema) -> DataFrame:
    """C5 alone: graded disagreement of the two paths, emptiness not special."""
    return df.withColumn("disagreement", by_field(schema, lambda s: C.graded(
        s, F.col("con_c"), F.col("unc_c"), F.col("con_key"), F.col("unc_key"))))


def flag_column(schema: Schema, threshold: float | Column) -> Column:
    """C6 as a column over canonical texts and ``score``."""
    return by_field(schema, lambda s: C.is_flagged(s, F.col("con_n"), F.col("unc_n"), F.col("score"), threshold))


def flag(df: DataFrame, schema: Schema, threshold: float | Column = 0.5) -> DataFrame:
    """Adds ``flagged``; threshold may be a column (threshold sweeps)."""
    return fence(df.withColumn("flagged", flag_column(schema, threshold)))


def worklist(flagged: DataFrame) -> DataFrame:
    """V1: only flagged fields go to the arbiter: (run_id, doc_id, ord, field)."""
    return fenced_filter(flagged, F.col("flagged")).select("run_id", "doc_id", "ord", "field")
