"""Correctness against gold (M1, M2, M18) as columns of the long table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon as N
from ..functions.fields import by_field, fence
from ..spec import Schema


def evaluate(df: DataFrame, schema: Schema, value: str = "kept") -> DataFrame:
    """Adds ``con_ok``, ``unc_ok``, ``final_ok`` (on ``value``), ``corrupted``
    (constrained wrong and free-form right) and ``changed`` (canonical final
    differs from canonical constrained).

    ``value`` is "kept" (after the optional absence repair) or "final" (as
    resolved); both reuse the key computed during resolution.
    """
    if "final_key0" in df.columns and value in ("kept", "final"):
        key = F.col("final_key0")
        if value == "kept" and "repaired" in df.columns:
            empty = by_field(schema, lambda s: F.array().cast("array<string>") if s.multi
                             else F.array(F.lit("")))
            key = F.when(F.col("repaired"), empty).otherwise(key)
        out = df.withColumn("final_key", key)
    else:
        out = df.withColumn("final_key", by_field(schema, lambda s: N.canon_key(s, F.col(value))))
    return (out
            .withColumn("con_ok", F.col("con_key") == F.col("gold_key"))
            .withColumn("unc_ok", F.col("unc_key") == F.col("gold_key"))
            .withColumn("final_ok", F.col("final_key") == F.col("gold_key"))
            .withColumn("corrupted", ~F.col("con_ok") & F.col("unc_ok"))
            .withColumn("changed", F.col("final_key") != F.col("con_key"))
            .transform(fence))
