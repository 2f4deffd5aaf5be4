"""Registered queries: one DataFrame per operator family, over whole tables.

Every query reads the driver's tables under ``sf_dir`` (through the F-TPCH
renderings or directly) and runs the library's jobs on all rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import fenced_filter
from ..operators import acquire as A
from ..operators import canonicalise as CN
from ..operators import confidence as K
from ..operators import extract as X
from ..operators import flags as FL
from ..operators import ground as G
from ..operators import metrics as M
from ..operators import postings as PO
from ..operators import resolve as R
from ..operators import studies as ST
from ..session import limit_methods, materialize, scratch_path
from ..sources import contracts as CT
from ..sources import corpus as C
from ..sources import runs as RU
from ..sources.fixtures import AuditInputs, PageClient, read_table, tpch_audit_inputs
from .audit import AuditConfig, arbiter_answers, audit, calls_per_run, flagged_fields, scored_fields

#: The share of all fields that goes to review.
REVIEW_SHARE = 0.05
N_BOOT = 10_000
#: Two runs of a study: the same answers without and with the repair.
RUNS = {"plain": False, "repair": True}
LABELS = ("order_id", "customer", "total", "order_date", "priority", "nation")


def _inputs(spark: SparkSession, sf_dir: str) -> AuditInputs:
    limit_methods(spark)
    return tpch_audit_inputs(spark, sf_dir)


def _audit(spark, sf_dir, repair: bool = False) -> DataFrame:
    return audit(_inputs(spark, sf_dir), AuditConfig(ground_repair=repair))


def q_parse_json_path(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    return X.parse_constrained(inp.extractions, inp.schema).select("doc_id", "field", "value")


def q_parse_freeform_path(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    return X.parse_freeform(inp.extractions, inp.schema).select("doc_id", "field", "value")


def _canon(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    rows = X.field_rows(inp.extractions, inp.schema, documents=inp.documents, run_ids=inp.run_ids)
    return CN.canonicalise(rows, inp.schema, ("con", "unc", "gold"), typed=True)


def q_canon_number(spark, sf_dir):
    c = _canon(spark, sf_dir)
    return c.filter(F.col("field") == "total").select("doc_id", "con_num", "unc_num", "gold_num")


def q_canon_date(spark, sf_dir):
    c = _canon(spark, sf_dir)
    return c.filter(F.col("field") == "order_date").select("doc_id", "con_dt", "unc_dt", "gold_dt")


def q_canon_string(spark, sf_dir):
    c = _canon(spark, sf_dir)
    return c.filter(F.col("field").isin("order_id", "customer", "priority", "nation")).select(
        "doc_id", "field", "con_n", "unc_n", "gold_n")


def q_canon_set(spark, sf_dir):
    c = _canon(spark, sf_dir)
    return c.filter(F.col("field") == "suppliers").select("doc_id", "con_disp", "unc_disp", "gold_disp")


def q_canon_documents(spark, sf_dir):
    """N4 over whole natural texts, with number words, legal designators, spaced letters and accents planted at their ends."""
    tails = ("", " Twelve months, Limited", ": the Società CORPORATION", " (held by X) L. l. C", " Größe ÉTÉ one, two/three seven")
    d = read_table(spark, sf_dir, "documents").filter("text is not null")
    d = d.select("doc_id", F.concat("text", F.element_at(F.array(*map(F.lit, tails)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))).alias("document"))
    return G.canonical_text(d).select("doc_id", F.length("_text").alias("chars"), F.sha2("_text", 256).alias("canon_sha"))


def q_absence(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    optional = [f.name for f in inp.schema.fields if not f.required]
    rows = X.parse_freeform(inp.extractions, inp.schema).filter(F.col("field").isin(optional))
    return CN.absent(rows, inp.schema, "value").select("doc_id", "field", F.col("value_absent").alias("absent"))


def q_disagreement(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    s = scored_fields(inp)
    return s.select("doc_id", "field", M.r6(F.col("score")).alias("score"))


def q_flags(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    s = flagged_fields(inp)
    return s.select("doc_id", "field", "flagged")


def q_flag_worklist(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    s = flagged_fields(inp)
    return FL.worklist(s).select("run_id", "doc_id", "field")


def q_clean_answer(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    book = inp.answer_book.join(
        spark.createDataFrame([(i, f.name) for i, f in enumerate(inp.schema.fields)], "ord int, field string"),
        "field")
    return R.clean_arbiter(book.withColumnRenamed("raw", "arb_raw"), inp.schema).select(
        "doc_id", "field", F.col("arb").alias("cleaned"))


def q_resolve(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return a.select("doc_id", "field", "resolution", "confident",
                    F.array_join("final_key0", "; ").alias("final_canon"))


def q_final_record(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    a = audit(inp)
    return R.final_record(a, inp.schema, "final").drop("run_id")


def q_support(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return a.select("doc_id", "field", M.r6(F.col("support")).alias("support"))


def q_ground_repair(spark, sf_dir):
    a = _audit(spark, sf_dir, repair=True)
    return a.select("doc_id", "field", "repaired", F.array_join("final_key", "; ").alias("kept_canon"))


def q_ungrounded_gate(spark, sf_dir):
    return G.ungrounded_rate(_audit(spark, sf_dir))


def q_evidence_span(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    return G.evidence(audit(inp), inp.documents).drop("run_id")


def q_support_postings(spark, sf_dir):
    """G4/G5 by postings, for documents of any length; the same results as ``support``."""
    inp = _inputs(spark, sf_dir)
    rows = materialize(audit(inp).select("run_id", "doc_id", "ord", "field", "final"), "final-values")
    found = PO.posting_support(rows, inp.documents, inp.schema)
    return found.join(rows.select("run_id", "doc_id", "ord", "field"), ["run_id", "doc_id", "ord"]).select("doc_id", "field", M.r6(F.col("support")).alias("support"))


def q_confidence(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return a.select("doc_id", "field", M.r6(F.col("confidence")).alias("confidence"))


def q_review_topk(spark, sf_dir):
    """K2: the share of all fields with the least confidence."""
    a = materialize(_audit(spark, sf_dir).select("run_id", "doc_id", "doc_idx", "ord", "field", "confidence"), "confidences")
    return K.review_share(a, REVIEW_SHARE).filter("route = 'review'").select("doc_id", "field", M.r6(F.col("confidence")).alias("confidence"))


def q_accuracy_by_doc(spark, sf_dir):
    d = M.per_document(_audit(spark, sf_dir))
    return d.select("doc_id", M.r6(F.col("con_acc")).alias("con_acc"),
                    M.r6(F.col("final_acc")).alias("final_acc"))


def q_accuracy_by_field(spark, sf_dir):
    return M.accuracy_by_field(_audit(spark, sf_dir)).drop("run_id")


def q_corrupted(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return fenced_filter(a, F.col("corrupted")).select("doc_id", "field")


def q_flag_pr_by_doc(spark, sf_dir):
    d = M.per_document(_audit(spark, sf_dir))
    return d.select("doc_id", M.r6(F.col("flag_precision")).alias("flag_precision"),
                    M.r6(F.col("flag_recall")).alias("flag_recall"))


def q_run_report(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    return M.run_report(audit(inp), inp.schema)


def q_run_report_repair(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    return M.run_report(audit(inp, AuditConfig(ground_repair=True)), inp.schema)


def q_sweep(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    rows = X.field_rows(inp.extractions, inp.schema, inp.answer_book, inp.documents, run_ids=inp.run_ids)
    rows = CN.canonicalise(rows, inp.schema, ("con", "unc", "gold"))
    return ST.sweep(FL.score(rows, inp.schema), inp.schema).drop("run_id")


def q_tripwire(spark, sf_dir):
    return M.tripwire(_audit(spark, sf_dir))


def q_ground_confusion(spark, sf_dir):
    return ST.ground_confusion(_audit(spark, sf_dir))


def q_repair_what_if(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    a = audit(inp)
    a = G.support(a, inp.schema, "gold", "gold_support")
    return ST.repair_what_if(a, inp.schema)


def q_risk_coverage(spark, sf_dir):
    """M17 for both runs of a study."""
    return ST.risk_coverage(audit(_inputs(spark, sf_dir), runs=RUNS))


def q_bootstrap_ci(spark, sf_dir):
    """M10 for both runs of a study."""
    return ST.bootstrap_ci(M.per_document(audit(_inputs(spark, sf_dir), runs=RUNS)), n_boot=N_BOOT, seed=0)


def q_bootstrap_mean(spark, sf_dir):
    """M10 as far as it doesn't depend on the draws: the interval brackets the mean."""
    ci = ST.bootstrap_ci(M.per_document(_audit(spark, sf_dir)), n_boot=N_BOOT, seed=0)
    return ci.select("mean", "docs", "n_boot", ((F.col("lo95") <= F.col("mean")) & (F.col("mean") <= F.col("hi95"))).alias("bracketed"))


def q_requests(spark, sf_dir):
    """A hash of every prompt: both extractions of all documents and one for each flagged field."""
    inp = _inputs(spark, sf_dir)
    both = A.extraction_requests(inp.documents, inp.schema, inp.run_ids[0])
    asked = A.arbiter_requests(FL.worklist(flagged_fields(inp)), inp.documents, inp.schema)
    return both.unionByName(asked).select("run_id", "doc_id", "path", "field", "force_json", F.sha2("prompt", 256).alias("prompt_sha"))


def q_acquired_cost(spark, sf_dir):
    """V1 -> P5 -> V2 -> M7: only flagged fields get a recorded answer; calls are counted rows."""
    inp = _inputs(spark, sf_dir)
    answers = materialize(arbiter_answers(inp), "answers")
    report = M.run_report(audit(inp, arbiter=answers), inp.schema).select("run_id", "final_acc", "low_confidence")
    return calls_per_run(inp, answers).join(report, "run_id")


def q_answer_ledger(spark, sf_dir):
    """Every flagged field is asked of a client that fails for some orders, then those that failed are asked again.

    One row per request: its answer or its last error, and how often it was tried and asked.
    """
    inp = _inputs(spark, sf_dir)
    wanted = materialize(A.arbiter_requests(FL.worklist(flagged_fields(inp)), inp.documents, inp.schema), "arbiter-requests")
    store = scratch_path(spark, "ledger")
    for every in (53, 106):
        A.ask(wanted, lambda every=every: PageClient(every), store)
    return A.latest(A.ledger(spark, store)).select("run_id", "doc_id", "field", "prompt_sha", "raw", "error", "tries", "calls")


def q_counterfactual(spark, sf_dir):
    return M.counterfactual(_audit(spark, sf_dir)).drop("run_id")


def q_changed_fields(spark, sf_dir):
    return M.changed_fields(_audit(spark, sf_dir)).drop("run_id")


def q_cost_points(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    return M.cost_points(M.run_report(audit(inp), inp.schema))


def _stored_runs(spark, sf_dir):
    """Two runs, without and with repair, stored as a study would find them; the run without repair was stored before,
    and wrongly, so its second version replaces one."""
    inp = _inputs(spark, sf_dir)
    root = scratch_path(spark, "runs")
    # what a run stores and no more: the document's features stand in each of its fields' rows
    rows = materialize(audit(inp, runs=RUNS).select("run_id", *RU.TRACE), "audited")
    RU.write_run(rows.filter("run_id = 'plain' and ord < 2"), inp.schema, root)
    RU.adopt_run(rows, inp.schema, root)
    # a cell for each region's name and configuration; the regions' own runs were never made
    region = read_table(spark, sf_dir, "region").select(F.lower("r_name").alias("corpus"))
    cells = region.select("corpus", F.explode(F.array(*map(F.lit, RUNS))).alias("config")).select(F.concat_ws("-", "config", "corpus").alias("run_id"), "corpus", (F.col("config") == "repair").alias("repair"))
    made = spark.createDataFrame([(n, "tpch", r) for n, r in RUNS.items()], cells.schema)
    return inp, root, made.unionByName(cells)


def q_field_trace(spark, sf_dir):
    """M20 over stored runs."""
    inp, root, _ = _stored_runs(spark, sf_dir)
    trace = RU.field_trace(RU.read_fields(spark, root), inp.schema)
    return trace.select("run_id", "doc_id", "field", "score", "support", "flagged", "correct", "optional")


def q_cell_summary(spark, sf_dir):
    """M21 over stored runs; cells without a run have nulls."""
    _, root, cells = _stored_runs(spark, sf_dir)
    return RU.cell_summary(cells, RU.read_reports(spark, root))


def q_missing_cells(spark, sf_dir):
    """Cells of the study without a stored run."""
    _, root, cells = _stored_runs(spark, sf_dir)
    return RU.missing_cells(cells, RU.read_reports(spark, root))


def q_stored_sweep(spark, sf_dir):
    """A sweep's points, written and read again."""
    path = scratch_path(spark, "points")
    RU.write_points(q_sweep(spark, sf_dir), path)
    return RU.read_points(spark, path)


def q_corpus_order(spark, sf_dir):
    """Documents in files of unequal sizes, whose paths run against the ids, read again as one corpus in order."""
    path = scratch_path(spark, "many-files")
    k = F.floor(F.sqrt("doc_id"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"), F.lpad((1_000_000 - k).cast("string"), 7, "0").alias("part"),
                                                          F.create_map(F.lit("k"), k.cast("string")).alias("gold"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "document", "gold").write.partitionBy("part").json(path)
    return C.read_jsonl_corpus(spark, path).select("doc_idx", F.sha2("document", 256).alias("document_sha"), F.element_at("gold", "k").alias("k"))


def q_corpus_catalog(spark, sf_dir):
    """A corpus for each language, and one that isn't there."""
    path = scratch_path(spark, "corpora")
    docs = read_table(spark, sf_dir, "documents").filter("lang is not null")
    rows = docs.select("lang", "doc_id", F.col("text").alias("document"), F.create_map(F.lit("source"), "source").alias("gold"))
    # by ranges, as a language may be most of the table: its files' names follow the ranges
    rows.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "document", "gold").write.partitionBy("lang").json(path)
    langs = [r["lang"] for r in docs.select("lang").distinct().collect()]  # a row per corpus
    found = C.corpus_catalog(spark, {x: f"{path}/lang={x}" for x in (*langs, "absent")})
    return found.select("corpus", "present", "records", "doc_idx", F.sha2("document", 256).alias("document_sha"))


def q_contracts(spark, sf_dir):
    """Documents as quoted fields of a TSV file that many tasks write and read, and their labels in another."""
    texts, labels = scratch_path(spark, "contracts"), scratch_path(spark, "labels")
    docs = read_table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    ranged.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.lit('5" x'), F.coalesce("lang", F.lit("")), F.lit("d"), F.lit("e"), quoted)).write.text(texts)
    line = F.concat_ws(" ", F.concat(F.lit("term="), F.col("n_chars").cast("string"), F.lit("_chars")),
                       F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("party=A_"), F.col("doc_id").cast("string"), F.lit(" party=B"))))
    ranged.select(line).write.text(labels)
    found = CT.read_contracts(spark, texts, labels, ("term", "jurisdiction"), "party")
    return found.select("doc_idx", F.sha2("document", 256).alias("document_sha"), *(F.element_at("gold", k).alias(k) for k in ("term", "jurisdiction", "party")))


def q_receipts(spark, sf_dir):
    """Suppliers as receipts: boxes with short rows and commas, some missing or empty, and keys that lack a value."""
    s = read_table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    stem, money = F.format_string("%05d receipt", "k").alias("stem"), F.format_string("%.2f", "s_acctbal")
    box = "1,2,3,4,5,6,7,8,"
    lines = F.concat_ws("\n", F.concat(F.lit(box), "s_name"), F.lit("1,2,3"), F.concat(F.lit(box + "TOTAL, RM "), money), F.lit(""), F.lit(box))
    boxes = s.filter("k % 7 <> 3").select(stem, F.when(F.col("k") % 11 == 4, "").otherwise(lines).alias("value"))
    key = F.to_json(F.struct(F.col("s_name").alias("company"), F.lit("2020-01-05").alias("date"), F.concat(F.lit("No. "), F.col("k").cast("string")).alias("address"),
                             F.when(F.col("k") % 13 != 5, money).alias("total")))
    names = ("company", "date", "address", "total")
    found = C.receipts(C.box_text(boxes), C.keys_of(s.select(stem, key.alias("value")), names))
    return found.select("stem", "document", *(F.element_at("gold", n).alias(n) for n in names))


def q_gold_keys(spark, sf_dir):
    """Q1: exact key sets, with orders that lack a key and orders that have one more."""
    inp = _inputs(spark, sf_dir)
    k, gold = F.col("doc_id"), F.col("gold")
    fewer = F.map_filter(gold, lambda n, _: n != "nation")
    docs = inp.documents.withColumn("gold", F.when(F.pmod(k, F.lit(59)) == 3, fewer).when(F.pmod(k, F.lit(61)) == 4, F.map_concat(gold, F.create_map(F.lit("extra"), F.lit("1")))).otherwise(gold))
    return C.gold_keys(docs, tuple(inp.schema.names))


def q_breakdown_cube(spark, sf_dir):
    return M.breakdown_cube(_audit(spark, sf_dir))


def q_corpus_shape(spark, sf_dir):
    return C.corpus_shape(read_table(spark, sf_dir, "documents"))


def q_escape_residue(spark, sf_dir):
    return C.escape_residue(read_table(spark, sf_dir, "documents"))


def q_fingerprint(spark, sf_dir):
    return C.fingerprints(read_table(spark, sf_dir, "documents"))


def q_corpus_digest(spark, sf_dir):
    return C.corpus_digest(C.fingerprints(read_table(spark, sf_dir, "documents")))


def q_corpus_identical(spark, sf_dir):
    """Q5: the corpus against itself without trailing blanks and line ends."""
    d = read_table(spark, sf_dir, "documents")
    return C.same_corpus(C.fingerprints(d), C.fingerprints(d.withColumn("text", F.regexp_replace("text", r"[ \n]+$", ""))))


def q_corpus_sample(spark, sf_dir):
    return C.corpus_sample(read_table(spark, sf_dir, "documents"), "lang", 6).select(
        "lang", "doc_id", "rank")


def q_clause_reduce(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    r = C.clause_reduce(d.select("doc_id", F.col("text")))
    return r.select("doc_id", F.length("reduced").alias("reduced_len"),
                    F.sha2("reduced", 256).alias("reduced_sha"), "dropped")


def q_gold_absence(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    g = inp.documents.select(F.explode("gold").alias("field", "value"))
    return g.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "").alias("absent"))


def _label_lines(inp):
    """Stand-in label lines, with another total where k % 41 = 7 and else no date where k % 43 = 5."""
    k, line = F.col("doc_id"), F.col("line")
    return C.label_lines(inp.documents, LABELS, "suppliers").withColumn(
        "line", F.when(F.pmod(k, F.lit(41)) == 7, F.regexp_replace(line, r"total=\S*", "total=0.00"))
        .when(F.pmod(k, F.lit(43)) == 5, F.regexp_replace(line, r"order_date=\S*", "")).otherwise(line))


def q_label_parse(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    return C.parse_label_lines(_label_lines(inp), LABELS, "suppliers")


def q_provenance_diff(spark, sf_dir):
    inp = _inputs(spark, sf_dir)
    return C.provenance_diff(C.parse_label_lines(_label_lines(inp), LABELS, "suppliers"), inp.documents)


def q_events_json(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    from ..spec import FieldSpec, Schema
    schema = Schema("event_props", (FieldSpec("k", "number"),))
    x = ev.select(F.lit("events").alias("run_id"), F.col("event_id").alias("doc_id"),
                  F.col("props").alias("constrained_raw"), F.lit("").alias("unconstrained_raw"))
    p = X.parse_constrained(x, schema)
    p = CN.canonicalise(p.withColumnRenamed("value", "con"), schema, ("con",), typed=True)
    return p.select(F.col("doc_id").alias("event_id"), "con_num")


def q_stage_events(spark, sf_dir):
    from ..streaming.feed import stage_rows
    inp = _inputs(spark, sf_dir)
    ev = stage_rows(audit(inp), inp.schema)
    return ev.groupBy("stage").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def q_stage_payloads(spark, sf_dir):
    """Hashes of what every stage says of every document."""
    from ..streaming.feed import stage_rows
    inp = _inputs(spark, sf_dir)
    ev = stage_rows(audit(inp), inp.schema)
    return ev.select("doc_id", "seq", "stage", F.sha2("payload", 256).alias("payload_sha"))


def q_ungrounded_monitor(spark, sf_dir):
    from ..streaming.feed import ungrounded_windows
    inp = _inputs(spark, sf_dir)
    a = audit(inp)
    ts = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"),
                                                   F.col("o_orderdate").cast("timestamp").alias("ts"))
    w = ungrounded_windows(a.join(ts, "doc_id"), "30 days")
    return w.withColumn("window_start", F.col("window_start").cast("date"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
