"""Source grounding job (G1-G9): document features, support, repair, rate."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon as N
from ..functions import ground as G
from ..functions.fields import by_field, fence, field_attr
from ..spec import Schema

FEATURES = ("tokens", "numbers", "dates", "folded")


def canonical_text(documents: DataFrame) -> DataFrame:
    """Adds ``_text``, the string canonical form of ``document``."""
    x = documents.withColumn("_sp", N.column_prepared(F.col("document")))
    x = x.withColumn("_sw", N.number_words(F.col("_sp")))
    x = x.withColumn("_sx", N.legal_suffix(F.col("_sw")))
    return x.withColumn("_text", N.spaced_tail(F.col("_sx"), N.tail_of(F.col("_sx")))).drop("_sp", "_sw", "_sx")


def distinct_tokens(text: Column) -> Column:
    """G1 of a canonical text referenced by name: its tokens and their trailing-s forms, each once, from two splits of it."""
    bare = F.split(F.regexp_replace(text, "s+(?= |$)", ""), " ")
    return F.array_distinct(F.array_remove(F.concat(F.split(text, " "), bare), ""))


def document_features(documents: DataFrame) -> DataFrame:
    """G1-G3, computed once per document, map-side (no shuffle).

    The document's string canonical form is built in stages (each step once,
    in generated code); tokens and their trailing-s forms come from two splits
    of it, not from a per-token function.
    """
    d, x = F.col("document"), canonical_text(documents)
    x = x.withColumn("_spans", G.date_spans(d))
    x = x.select("*", distinct_tokens(F.col("_text")).alias("tokens"),
                 G.doc_numbers(d).alias("numbers"), G.dates_of(F.col("_spans")).alias("dates"),
                 G.doc_folded(d).alias("folded"))
    return x.drop("_text", "_spans")


def needed_features(df: DataFrame, schema: Schema) -> DataFrame:
    """Keeps in each field's row only the features that support of such a field reads, as every later step copies them."""
    reads = {"tokens": lambda f: not f.numeric and f.type != "date", "numbers": lambda f: f.numeric,
             "dates": lambda f: f.type == "date", "folded": lambda f: f.type == "date"}
    return df.withColumns({c: F.when(F.col("ord").isin(*(i for i, f in enumerate(schema.fields) if r(f))), F.col(c)) for c, r in reads.items()})


def support(df: DataFrame, schema: Schema, value: str = "final",
            out: str = "support") -> DataFrame:
    """Support of ``value`` against the row's document features (uses the
    value's canon struct ``<value>_c`` and its set of elements when present)."""
    t, n, d, f = (F.col(c) for c in FEATURES)
    canon = F.col(f"{value}_c") if f"{value}_c" in df.columns else None
    key = "final_key0" if value == "final" else f"{value}_key"
    elements = F.col(key) if key in df.columns else None
    return fence(df.withColumn(out, by_field(schema, lambda s: G.support(
        s, F.col(value), t, n, d, f, canon if not s.multi else None, elements))))


def ground(df: DataFrame, schema: Schema, ground_threshold: float = 0.5,
           repair: bool = False, value: str = "final", runs: dict[str, bool] | None = None) -> DataFrame:
    """``support`` (pre-repair), ``ungrounded`` and ``kept`` (the value
    after the opt-in absence repair of unsupported optional fields).

    ``runs`` names runs that differ in nothing but the repair: each field's row is
    then there once for each of them, with its ``run_id``, and support is scored once.
    """
    out = support(df, schema, value)
    if runs:
        each = F.array(*(F.struct(F.lit(n).alias("run_id"), F.lit(r).alias("_repair")) for n, r in runs.items()))
        out = out.drop("run_id").select("*", F.inline(each))
    out = out.withColumn("ungrounded", F.col("support") < F.lit(ground_threshold))
    optional = ~field_attr(schema, "required")
    repaired = (F.col("_repair") if runs else F.lit(repair)) & optional & F.col("ungrounded")
    return (out.withColumn("repaired", repaired).drop("_repair")
            .withColumn("kept", F.when(F.col("repaired"), F.lit("")).otherwise(F.col(value)))
            .transform(fence))


def ungrounded_rate(grounded: DataFrame, band: float = 0.10) -> DataFrame:
    """Gold-free ungrounded rate per run and the FABRICATING band."""
    return (grounded.groupBy("run_id")
            .agg(F.count_if("ungrounded").alias("ungrounded"), F.count("*").alias("fields"))
            .withColumn("rate", F.round(F.col("ungrounded") / F.col("fields"), 6))
            .withColumn("band", F.when(F.col("rate") >= band, F.lit("FABRICATING"))
                        .otherwise(F.lit("reliable"))))


def evidence(rows: DataFrame, documents: DataFrame, value: str = "kept") -> DataFrame:
    """(run_id, doc_id, field, span_start, span_end): the literal evidence span of each row's value in its document.

    A document's values (a few per run) meet it in one row, where its text is
    lowered once and stays; only spans leave that row.
    """
    values = rows.groupBy("doc_id").agg(F.collect_list(F.struct("run_id", "field", F.col(value).alias("v"))).alias("_values"))
    x = documents.select("doc_id", F.lower("document").alias("_low")).join(values, "doc_id")

    def located(e):
        span = G.evidence_span(e["v"], F.col("_low"))
        return F.struct(e["run_id"].alias("run_id"), e["field"].alias("field"), span["start"].alias("span_start"), span["end"].alias("span_end"))
    return x.select("doc_id", F.inline(F.transform("_values", located))).select("run_id", "doc_id", "field", "span_start", "span_end")
