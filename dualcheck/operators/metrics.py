"""Run reports (M1-M7, M12, M18-M23) over the audited field table.

Two-level aggregations: per document first (each document's field rows come
from one input row, so partial aggregation collapses them map-side before the
shuffle), then per run over one small row per document.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import Schema


def r6(c: Column) -> Column:
    """Ratios are rounded to 6 places so engines agree on the printed value."""
    return F.round(c, 6)


def _ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num / den)


def flag_rates(flagged: Column, corrupted: Column, hits: Column) -> tuple[Column, Column]:
    """M3 precision and recall of flags. Vacuous rules: no flags -> 1/1 when
    nothing was corrupted, else 0/0; flags but nothing corrupted -> recall 1."""
    vacuous = F.when(corrupted == 0, 1.0).otherwise(0.0)
    precision = F.when(flagged == 0, vacuous).otherwise(hits / flagged)
    recall = F.when(flagged == 0, vacuous).when(corrupted == 0, F.lit(1.0)).otherwise(hits / corrupted)
    return precision, recall


def per_document(audited: DataFrame, keys: tuple[str, ...] = ("run_id", "doc_id")) -> DataFrame:
    """M1-M3 per document: correct counts, corrupted and flagged sets, P/R."""
    d = audited.groupBy(*keys).agg(
        F.count("*").alias("n_fields"),
        F.count_if("con_ok").alias("con_correct"),
        F.count_if("final_ok").alias("final_correct"),
        F.count_if("corrupted").alias("n_corrupted"),
        F.count_if("flagged").alias("n_flagged"),
        F.count_if(F.col("flagged") & F.col("corrupted")).alias("flag_tp"),
        F.count_if(~F.col("confident")).alias("low_confidence"),
        F.count_if("ungrounded").alias("ungrounded") if "ungrounded" in audited.columns
        else F.lit(0).alias("ungrounded"))
    precision, recall = flag_rates(F.col("n_flagged"), F.col("n_corrupted"), F.col("flag_tp"))
    return d.select("*", (F.col("con_correct") / F.col("n_fields")).alias("con_acc"),
                    (F.col("final_correct") / F.col("n_fields")).alias("final_acc"),
                    precision.alias("flag_precision"), recall.alias("flag_recall"))


def run_report(audited: DataFrame, schema: Schema) -> DataFrame:
    """M4-M7 (+G8): one row per run. Calls = 2 per document + one arbiter call
    per flagged field; the verify-everything baseline is docs x (2 + fields)."""
    n = len(schema.fields)
    d = per_document(audited)
    r = d.groupBy("run_id").agg(
        F.count("*").alias("docs"), F.avg("con_acc").alias("ca"), F.avg("final_acc").alias("fa"),
        F.sum("n_corrupted").alias("flag_corrupted"), F.sum("n_flagged").alias("flag_flagged"),
        F.sum("flag_tp").alias("flag_tp"), F.avg("flag_precision").alias("fp"),
        F.avg("flag_recall").alias("fr"), F.sum("low_confidence").alias("low_confidence"),
        F.sum("ungrounded").alias("ungrounded"))
    fields_total = F.col("docs") * n
    calls = F.col("docs") * 2 + F.col("flag_flagged")
    full = F.col("docs") * (2 + n)
    return r.select(
        "run_id", "docs", fields_total.alias("fields_total"),
        r6("ca").alias("constrained_acc"), r6("fa").alias("final_acc"),
        r6(_ratio(F.col("flag_corrupted"), fields_total, 0.0)).alias("corruption_rate"),
        r6("fp").alias("flag_precision"), r6("fr").alias("flag_recall"),
        r6(_ratio(F.col("flag_tp"), F.col("flag_flagged"), 1.0)).alias("flag_precision_micro"),
        r6(_ratio(F.col("flag_tp"), F.col("flag_corrupted"), 1.0)).alias("flag_recall_micro"),
        "flag_tp", "flag_flagged", "flag_corrupted",
        calls.alias("llm_calls"), full.alias("full_verify_calls"),
        r6(F.lit(1.0) - calls / full).alias("calls_saved"),
        "low_confidence", "ungrounded",
        r6(_ratio(F.col("ungrounded"), fields_total, 0.0)).alias("ungrounded_rate"))


def accuracy_by_field(audited: DataFrame) -> DataFrame:
    """Accuracy per field (and on gold-absent fields)."""
    return audited.groupBy("run_id", "field").agg(
        F.count("*").alias("n"),
        r6(F.avg(F.col("con_ok").cast("double"))).alias("constrained_acc"),
        r6(F.avg(F.col("final_ok").cast("double"))).alias("final_acc"),
        F.count_if(F.col("gold_n") == "").alias("gold_absent"),
        F.count_if((F.col("gold_n") == "") & F.col("final_ok")).alias("absent_right"))


def breakdown_cube(audited: DataFrame) -> DataFrame:
    """M23 packaged as a cube over (run, field): totals per run, per field and overall."""
    return audited.cube("run_id", "field").agg(
        F.count("*").alias("n"), F.count_if("final_ok").alias("final_correct"),
        F.count_if("con_ok").alias("con_correct"))


def tripwire(audited: DataFrame) -> DataFrame:
    """Warn when more than half of the final answers are absent, by the
    scalar form of the whole answer (also of a list)."""
    r = audited.groupBy("run_id").agg(
        F.count_if(F.col("repaired") | (F.col("final_c.text") == "")).alias("absent"),
        F.count("*").alias("fields"))
    return r.withColumn("warn", F.col("absent") > F.floor(F.col("fields") / 2))


def counterfactual(audited: DataFrame) -> DataFrame:
    """Per document, baseline (constrained) vs final correct sets."""
    d = audited.groupBy("run_id", "doc_id").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("con_ok"), F.col("field")))).alias("baseline_correct"),
        F.sort_array(F.collect_list(F.when(F.col("final_ok"), F.col("field")))).alias("final_correct"))
    return d.select(
        "run_id", "doc_id",
        r6(F.size("baseline_correct") / F.col("n")).alias("baseline_acc"),
        r6(F.size("final_correct") / F.col("n")).alias("final_acc"),
        F.array_join(F.array_except("final_correct", "baseline_correct"), ",").alias("repaired"),
        F.array_join(F.array_except("baseline_correct", "final_correct"), ",").alias("broken"))


def changed_fields(audited: DataFrame) -> DataFrame:
    """Fields whose canonical final differs from the constrained value."""
    return audited.groupBy("run_id", "field").agg(F.count_if("changed").alias("changed"))


def cost_points(report: DataFrame) -> DataFrame:
    """Accuracy-vs-cost points per run, with the baseline cost."""
    return report.select("run_id", "final_acc", "constrained_acc", "llm_calls",
                         "full_verify_calls", "calls_saved", "low_confidence")
