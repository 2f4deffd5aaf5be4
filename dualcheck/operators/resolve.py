"""Resolution of flagged fields by majority with a blind arbiter (V2-V4)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from . import canonicalise as CN
from ..functions.fields import by_field, fence
from ..spec import Schema


def clean_arbiter(df: DataFrame, schema: Schema, asked: Column | None = None) -> DataFrame:
    """R3 on ``arb_raw`` -> ``arb``; an answer that was never obtained, or not asked for, stays null."""
    there = F.col("arb_raw").isNotNull()
    clean = by_field(schema, lambda s: P.clean_answer(s, F.col("arb_raw")))
    return fence(df.withColumn("arb", F.when(there if asked is None else there & asked, clean)))


def arbitrated(df: DataFrame, schema: Schema, asked: Column | None = None) -> DataFrame:
    """The arbiter's side of V2, the same for every threshold: ``arb``, ``arb_c``,
    ``arb_key``, and whether it agrees with the free-form and the constrained path.
    Where it was not ``asked`` (default: everywhere it was), nothing of it is worked out."""
    out = clean_arbiter(df, schema, asked)
    out = out.select("*", CN.prepared_list(schema, "arb", F.col("arb").isNotNull()))
    out = CN.staged_canon(out, schema, "arb", "arb_c")
    out = out.withColumn("arb_key", CN.equality_key(schema, "arb")).drop("_arb_list")
    answered = F.col("arb").isNotNull()
    return (out.withColumn("with_unc", answered & (F.col("arb_key") == F.col("unc_key")))
            .withColumn("with_con", answered & (F.col("arb_key") == F.col("con_key"))).transform(fence))


def resolve(df: DataFrame, schema: Schema) -> DataFrame:
    """V2: adds ``final``, ``resolution`` and ``confident``.

    Unflagged -> constrained ("agreement"). Flagged: arbiter agrees with the
    free-form path -> the arbiter's cleaned text ("majority"); agrees with the
    constrained path -> constrained ("majority"); else constrained kept,
    "split-kept", not confident. Equality is the shared canonical key. A flagged
    field whose answer was never obtained agrees with no path: split-kept.
    """
    flagged, with_unc, with_con = F.col("flagged"), F.col("with_unc"), F.col("with_con")
    return (arbitrated(df, schema, flagged)
            .withColumn("resolution", F.when(~flagged, F.lit("agreement"))
                        .when(with_unc | with_con, F.lit("majority"))
                        .otherwise(F.lit("split-kept")))
            .withColumn("from_arb", flagged & with_unc)
            .withColumn("final", F.when(F.col("from_arb"), F.col("arb")).otherwise(F.col("con")))
            .withColumn("final_c", F.when(F.col("from_arb"), F.col("arb_c")).otherwise(F.col("con_c")))
            .withColumn("final_key0", F.when(F.col("from_arb"), F.col("arb_key"))
                        .otherwise(F.col("con_key")))
            .withColumn("confident", F.col("resolution") != "split-kept")
            .transform(fence))


def final_record(resolved: DataFrame, schema: Schema, value: str = "final") -> DataFrame:
    """V3: one row per (run_id, doc_id), one column per field, schema order.

    Conditional aggregation over a known field list; each group is one
    document's fields, bounded by the schema.
    """
    return resolved.groupBy("run_id", "doc_id").agg(*[
        F.max(F.when(F.col("ord") == i, F.col(value))).alias(f.name)
        for i, f in enumerate(schema.fields)])


def low_confidence(resolved: DataFrame) -> DataFrame:
    """V4: count of not-confident fields per run."""
    return resolved.groupBy("run_id").agg(F.count_if(~F.col("confident")).alias("low_confidence"))
