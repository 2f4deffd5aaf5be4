"""The audit plan: extract -> canonicalise -> flag -> arbiter -> resolve ->
ground -> confidence -> evaluate, as one DataFrame over (run, doc, field).

Physical shape: the per-run tables (extractions, arbiter answers) are joined on
(run_id, doc_id) and meet the documents once on doc_id; every later step is a
row-local column expression, so the only exchanges are that join and the
report aggregations. Document features are computed behind the join, so that
the shuffle carries the document itself and nothing made of it, and are pruned
by Catalyst when a query does not read them.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import acquire as A
from ..operators import canonicalise as CN
from ..operators import confidence as K
from ..operators import evaluate as E
from ..operators import extract as X
from ..operators import flags as FL
from ..operators import ground as G
from ..operators import resolve as R
from ..sources.fixtures import AuditInputs


@dataclass(frozen=True)
class AuditConfig:
    threshold: float = 0.5
    ground_threshold: float = 0.5
    ground_repair: bool = False


def scored_fields(inputs: AuditInputs) -> DataFrame:
    """Both paths per field of every document with canonical forms and the
    disagreement score; no document's text is read."""
    rows = X.field_rows(inputs.extractions, inputs.schema, documents=inputs.documents, run_ids=inputs.run_ids)
    rows = CN.canonicalise(rows, inputs.schema, ("con", "unc"))
    return FL.score(rows, inputs.schema)


def flagged_fields(inputs: AuditInputs, threshold: float = 0.5) -> DataFrame:
    return FL.flag(scored_fields(inputs), inputs.schema, threshold)


def arbiter_answers(inputs: AuditInputs, threshold: float = 0.5) -> DataFrame:
    """Recorded arbiter answers for the flagged work list at ``threshold``."""
    work = FL.worklist(flagged_fields(inputs, threshold))
    return A.acquire_recorded(work, inputs.answer_book)


def audit(inputs: AuditInputs, config: AuditConfig = AuditConfig(),
          arbiter: DataFrame | None = None, runs: dict[str, bool] | None = None) -> DataFrame:
    """Full per-field audit table.

    ``runs`` gives the rows of several runs that differ in the repair only (name
    -> whether it repairs) from one pass over the inputs.

    ``arbiter`` holds the arbiter's answers (run_id, doc_id, field, raw). By
    default the recorded answer book is read directly: resolution reads an
    answer only where the field is flagged, so the outcome equals acquiring
    answers for the flagged work list first (``arbiter_answers``), without
    computing the flags twice. With a live client, acquire for the work list
    (``operators.acquire``) and pass the written answers here.
    """
    schema = inputs.schema
    if arbiter is None:
        arbiter = inputs.answer_book
    rows = X.field_rows(inputs.extractions, schema, arbiter, inputs.documents, G.FEATURES, inputs.run_ids, G.document_features)
    rows = G.needed_features(rows, schema)
    rows = CN.canonicalise(rows, schema, ("con", "unc", "gold"))
    rows = FL.flag(FL.score(rows, schema), schema, config.threshold)
    rows = R.resolve(rows, schema)
    rows = G.ground(rows, schema, config.ground_threshold, config.ground_repair, runs=runs)
    rows = K.confidence(rows)
    return E.evaluate(rows, schema, "kept")


def calls_per_run(inputs: AuditInputs, arbiter: DataFrame) -> DataFrame:
    """M7 from acquired response tables: 2 extraction calls per response row plus
    one per arbiter answer row (use with answers acquired for the work list)."""
    from pyspark.sql import functions as F
    ext = inputs.extractions.groupBy("run_id").agg((F.count("*") * 2).alias("extraction_calls"))
    arb = arbiter.groupBy("run_id").agg(F.count("*").alias("arbiter_calls"))
    return (ext.join(arb, "run_id", "left")
            .select("run_id", (F.col("extraction_calls")
                               + F.coalesce("arbiter_calls", F.lit(0))).alias("llm_calls")))
