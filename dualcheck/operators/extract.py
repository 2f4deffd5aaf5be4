"""Response tables -> long field table.

``extractions`` holds one row per (run_id, doc_id) with the raw answers of the
constrained (JSON) and unconstrained (free-form) paths. Parsing is row-local:
each raw text is parsed once into a map / a list of pairs, every schema field
is looked up in it, and the row is unrolled into one row per field with
``inline`` (no shuffle).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from ..spec import Schema


def _parsed(extractions: DataFrame, schema: Schema) -> DataFrame:
    """Both responses parsed: the text that is one JSON object (the answer, else
    what stands from its first brace to its last) and the free-form lines."""
    raw, inner = F.col("constrained_raw"), F.col("_b")
    x = extractions.select("*", P.objects(raw).alias("_a"), P.freeform_text(F.col("unconstrained_raw")).alias("_f"))
    x = x.select("*", F.when(~P.is_one(F.col("_a")), F.regexp_extract(raw, r"(?s)\{.*\}", 0)).alias("_b"))
    # what is read once is the answer: its text, and its keys
    x = x.select("*", P.objects(inner).alias("_i"))
    one, within = P.is_one(F.col("_a")), P.is_one(F.col("_i"))
    x = x.select("*", F.when(one, raw).when(within, inner).alias("_t"),
                 F.when(one, F.map_keys(F.get("_a", F.lit(0)))).when(within, F.map_keys(F.get("_i", F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("_k")).drop("_a", "_b", "_i")
    x = x.select("*", P.freeform_part(F.col("_f"), 1).alias("_fk"), P.freeform_part(F.col("_f"), 2).alias("_fv"))
    x = x.select("*", P.freeform_pairs(F.col("_fk"), F.col("_fv")).alias("_l")).drop("_f", "_fk", "_fv")
    x = x.select("*", F.from_json("_t", P._struct_ddl(schema.names), P._JSON_OPTS).alias("_r"))
    return x.select("*", *[x for i, f in enumerate(schema.fields) for x in (
        P.json_value(F.col("_r"), F.col("_k"), f.name).alias(f"_c{i}"),
        P.freeform_lookup(F.col("_l"), f.name).alias(f"_u{i}"))])


def parse_constrained(extractions: DataFrame, schema: Schema) -> DataFrame:
    """(run_id, doc_id, ord, field, value) from the JSON path."""
    x = _parsed(extractions, schema)
    return x.select("run_id", "doc_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("field"), F.col(f"_c{i}").alias("value"))
        for i, f in enumerate(schema.fields)])))


def parse_freeform(extractions: DataFrame, schema: Schema) -> DataFrame:
    """R2: (run_id, doc_id, ord, field, value) from the free-form path."""
    x = _parsed(extractions, schema)
    return x.select("run_id", "doc_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("field"), F.col(f"_u{i}").alias("value"))
        for i, f in enumerate(schema.fields)])))


def arbiter_wide(arbiter: DataFrame, schema: Schema) -> DataFrame:
    """Arbiter answers (run_id, doc_id, field, raw) -> one row per document with
    one column ``a<i>`` per field (conditional aggregation; the group is one
    document's flagged fields, bounded by the schema)."""
    return arbiter.groupBy("run_id", "doc_id").agg(*[
        F.max(F.when(F.col("field") == f.name, F.col("raw"))).alias(f"a{i}")
        for i, f in enumerate(schema.fields)])


def field_rows(extractions: DataFrame, schema: Schema,
               arbiter: DataFrame | None = None,
               documents: DataFrame | None = None,
               doc_columns: tuple[str, ...] = (), run_ids: tuple[str, ...] | None = None,
               derive: Callable[[DataFrame], DataFrame] = lambda df: df, carry: tuple[str, ...] = ()) -> DataFrame:
    """Both paths side by side for every schema field, plus gold and the
    arbiter's raw answer when given.

    Every table goes through one exchange at most, the wide document rows once
    whatever the number of runs. ``run_ids`` (default: the runs in
    ``extractions``, a few) are the runs of every document. With one run all
    tables meet on doc_id alone, so tables in buckets of doc_id meet as they
    stand; with several, the per-run tables are joined first on (run_id, doc_id)
    with the ids of all documents, and the result meets ``documents`` on doc_id.
    Of the gold map only the fields' values go along. ``derive`` adds columns of the document behind that join, so that only the
    document itself is shuffled. ``carry`` names columns of ``extractions`` that each row keeps.
    """
    base = _parsed(extractions, schema).drop("constrained_raw", "unconstrained_raw", "_t", "_l",
                                             "_k", "_r")
    sides = [base] if arbiter is None else [base, arbiter_wide(arbiter, schema)]
    keep = ["run_id", "doc_id", *carry]
    if documents is None:
        base = sides[0] if arbiter is None else sides[0].join(sides[1], ["run_id", "doc_id"], "left")
    else:
        gold = [F.coalesce(F.element_at("gold", F.lit(f.name)), F.lit("")).alias(f"_g{i}") for i, f in enumerate(schema.fields)]
        docs = documents.select("doc_id", "doc_idx", "document", *gold)
        if run_ids is None:
            run_ids = tuple(r["run_id"] for r in extractions.select("run_id").distinct().collect())
        # an arbiter's answers stay for documents without a response
        if len(run_ids) == 1:
            base = docs.withColumn("run_id", F.lit(run_ids[0]))
            for side in sides:
                base = base.join(side.filter(F.col("run_id") == run_ids[0]).drop("run_id"), "doc_id", "left")
        else:
            base = documents.select("doc_id", F.explode(F.array(*map(F.lit, run_ids))).alias("run_id"))
            for side in sides:
                base = base.join(side, ["run_id", "doc_id"], "left")
            base = docs.join(base, "doc_id")
        base = derive(base.fillna("", [f"_{p}{i}" for p in "cu" for i in range(len(schema.fields))]))
        keep += ["doc_idx", *doc_columns]
    structs = []
    for i, f in enumerate(schema.fields):
        cols = [F.lit(i).alias("ord"), F.lit(f.name).alias("field"),
                F.col(f"_c{i}").alias("con"), F.col(f"_u{i}").alias("unc")]
        if documents is not None:
            cols.append(F.col(f"_g{i}").alias("gold"))
        if arbiter is not None:
            cols.append(F.col(f"a{i}").alias("arb_raw"))
        structs.append(F.struct(*cols))
    return base.select(*keep, F.inline(F.array(*structs)))
