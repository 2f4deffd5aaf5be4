"""Flags, resolution, grounding and confidence on hand-built response tables."""
import json

from pyspark.sql import functions as F

from dualcheck.functions import ground as G
from dualcheck.operators import canonicalise as CN
from dualcheck.operators import extract as X
from dualcheck.operators import flags as FL
from dualcheck.operators import metrics as M
from dualcheck.operators import studies as ST
from dualcheck.plans.audit import AuditConfig, audit, scored_fields
from dualcheck.sources.fixtures import AuditInputs
from dualcheck.spec import FieldSpec, Schema

SCHEMA = Schema("consignment", (
    FieldSpec("parcel", "string"), FieldSpec("worth", "number"), FieldSpec("sent", "date"),
    FieldSpec("carriage", "enum", enum=("ECONOMY", "EXPRESS", "COURIER", "PICKUP")),
    FieldSpec("remark", "string", required=False)))
DOC = "CONSIGNMENT PK-7\nHanded in at Nordkai on 9 May 2027 for EXPRESS carriage.\nDeclared worth: 1,870.25\n"


def _inputs(spark, con: dict, unc: dict, arb: dict, gold: dict, doc=DOC):
    free = "\n".join(f"{k}: {v}" for k, v in unc.items())
    docs = spark.createDataFrame([(1, 0, doc, gold)], "doc_id long, doc_idx long, document string, gold map<string,string>")
    ext = spark.createDataFrame([("r", 1, json.dumps(con), free)],
                                "run_id string, doc_id long, constrained_raw string, unconstrained_raw string")
    book = spark.createDataFrame([("r", 1, k, v) for k, v in arb.items()] or [("r", 1, "x", "")],
                                 "run_id string, doc_id long, field string, raw string")
    return AuditInputs(docs, ext, book, SCHEMA)


GOLD = {"parcel": "PK-7", "worth": "1870.25", "sent": "2027-05-09", "carriage": "EXPRESS", "remark": ""}


def _rows(spark, **kw):
    a = audit(_inputs(spark, **kw), AuditConfig(ground_repair=kw.pop("repair", False)) if False else AuditConfig())
    return {r["field"]: r.asDict() for r in a.collect()}


def test_clean_document_costs_no_arbiter(spark):
    r = _rows(spark, con=GOLD, unc={**GOLD, "worth": "£1,870.25", "sent": "9 May 2027"}, arb={}, gold=GOLD)
    assert not any(v["flagged"] for v in r.values())
    assert all(v["resolution"] == "agreement" and v["final_ok"] for v in r.values())


def test_majority_with_free_form_takes_arbiter_text(spark):
    con = {**GOLD, "worth": "1970.25"}
    r = _rows(spark, con=con, unc=GOLD, arb={"worth": "The worth is 1,870.25."}, gold=GOLD)
    t = r["worth"]
    assert t["flagged"] and t["resolution"] == "majority" and t["final"] == "1,870.25" and t["final_ok"]
    assert t["corrupted"]


def test_majority_with_constrained_and_split_kept(spark):
    con = {**GOLD, "carriage": "ECONOMY", "parcel": "PK-7"}
    unc = {**GOLD, "carriage": "EXPRESS", "parcel": "PK-8"}
    r = _rows(spark, con=con, unc=unc, arb={"carriage": "COURIER", "parcel": "PK-7"}, gold=GOLD)
    assert r["carriage"]["resolution"] == "split-kept" and not r["carriage"]["confident"]
    assert r["carriage"]["final"] == "ECONOMY"
    assert r["parcel"]["resolution"] == "majority" and r["parcel"]["final"] == "PK-7"


def test_required_empty_is_flagged_optional_both_empty_is_not(spark):
    con = {k: v for k, v in GOLD.items() if k not in ("parcel", "remark")}
    unc = {k: v for k, v in GOLD.items() if k not in ("parcel", "remark")}
    r = _rows(spark, con=con, unc=unc, arb={}, gold=GOLD)
    assert r["parcel"]["flagged"] and r["parcel"]["score"] == 1.0
    assert not r["remark"]["flagged"]


def test_grounding_and_confidence(spark):
    con = {**GOLD, "remark": "Freedonia"}
    r = _rows(spark, con=con, unc=con, arb={}, gold=GOLD)
    assert r["remark"]["support"] == 0.0 and r["remark"]["ungrounded"]
    assert r["worth"]["support"] == 1.0 and r["sent"]["support"] == 1.0
    assert r["worth"]["confidence"] == 1.0 and r["remark"]["confidence"] == 0.5
    assert not r["remark"]["final_ok"]


def test_repair_blanks_unsupported_optional_only(spark):
    con = {**GOLD, "remark": "Freedonia", "parcel": "PK-99"}
    a = audit(_inputs(spark, con=con, unc=con, arb={}, gold=GOLD), AuditConfig(ground_repair=True))
    r = {x["field"]: x for x in a.collect()}
    assert r["remark"]["repaired"] and r["remark"]["kept"] == "" and r["remark"]["final_ok"]
    assert not r["parcel"]["repaired"] and r["parcel"]["kept"] == "PK-99"
    assert r["remark"]["support"] == 0.0  # pre-repair support is kept


def test_filter_on_audit_column_stays_small(spark):
    a = audit(_inputs(spark, con=GOLD, unc=GOLD, arb={}, gold=GOLD))
    plan = a.filter("flagged")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 2_000_000


def test_documents_without_a_response_and_answers_never_obtained(spark):
    inp = _inputs(spark, con={**GOLD, "carriage": "ECONOMY"}, unc=GOLD, arb={}, gold=GOLD)
    more = spark.createDataFrame([(2, 1, DOC, GOLD)], inp.documents.schema)
    inp.documents = inp.documents.unionByName(more)
    rows = {(r["doc_id"], r["field"]): r for r in audit(inp).collect()}
    assert len(rows) == 2 * len(SCHEMA.fields)
    lost = rows[2, "worth"]
    assert lost["run_id"] == "r" and lost["con"] == "" and lost["flagged"] and not lost["final_ok"]
    unasked = rows[1, "carriage"]
    assert unasked["flagged"] and unasked["resolution"] == "split-kept" and not unasked["confident"] and unasked["final"] == "ECONOMY"


def test_numbers_of_a_document(spark):
    found = spark.createDataFrame([("10.50,20 and 0.75,0.80 or 1,234.50",)], "d string").select(G.doc_numbers(F.col("d")).alias("n")).first()["n"]
    assert found == [10.5, 20.0, 0.75, 0.8, 1234.5]


def test_tripwire_reads_lists_as_one_answer(spark):
    rows = [("r", False, ("Acme; unknown".lower(),)), ("r", False, ("",)), ("r", True, ("x",))]
    df = spark.createDataFrame(rows, "run_id string, repaired boolean, final_c struct<text:string>")
    assert tuple(M.tripwire(df).first()) == ("r", 2, 3, True)


def test_equal_values_share_one_form(spark):
    """What a path repeats takes the form of the other path's value; forms are those of values taken alone."""
    values = ["PK-7", " Nordkai  Ltd. ", "twelve months", "", "n/a", "9 May 2027", "1,870.25"]
    rows = [("r", i, j, f.name, a, b, c) for i, (a, b, c) in enumerate([(x, y, z) for x in values for y in (x, "PK-7", None) for z in (x, y)]) for j, f in enumerate(SCHEMA.fields)]
    df = spark.createDataFrame(rows, "run_id string, doc_id long, ord int, field string, con string, unc string, gold string")
    both = CN.canonicalise(df, SCHEMA, ("con", "unc", "gold"), typed=True)
    for c in ("unc", "gold"):
        alone = CN.canonicalise(df.select("run_id", "doc_id", "ord", "field", F.col(c).alias("con")), SCHEMA, ("con",), typed=True)
        pick = lambda d, p: sorted(map(str, d.select("doc_id", "ord", f"{p}_n", f"{p}_key", f"{p}_num", f"{p}_dt").collect()))
        assert [x.replace(f"{c}_", "con_") for x in pick(both, c)] == pick(alone, "con")


def test_values_take_their_steps_together(spark):
    """The forms of more values cost no projections of their own, as each copies the row, but for values equal to the first."""
    df = spark.createDataFrame([("r", 1, 0, "id", "a", "b", "c")], "run_id string, doc_id long, ord int, field string, con string, unc string, gold string")
    steps = lambda *c: CN.canonicalise(df, SCHEMA, c)._jdf.queryExecution().optimizedPlan().toString().count("Project [")
    assert steps("con", "unc", "gold") <= steps("con") + 3


def test_runs_share_one_pass_and_documents_are_shuffled_once(spark):
    """A document without a response is in every run; the shuffle carries it once, and nothing made of it."""
    inp = _inputs(spark, con={**GOLD, "remark": "Freedonia"}, unc={**GOLD, "remark": "Freedonia"}, arb={}, gold=GOLD)
    inp.documents = inp.documents.unionByName(spark.createDataFrame([(2, 1, DOC, GOLD)], inp.documents.schema))
    inp.extractions = inp.extractions.unionByName(inp.extractions.withColumn("run_id", F.lit("q")))
    a = audit(AuditInputs(inp.documents, inp.extractions, inp.answer_book, SCHEMA, ("r", "q")))
    assert {(r["run_id"], r["doc_id"]) for r in a.collect()} == {(x, i) for x in "rq" for i in (1, 2)}
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.rindex("Join Inner"):]
    assert "document#" in join and not any(f" AS {c}#" in join for c in ("tokens", "numbers", "dates", "folded"))
    both = {(r["run_id"], r["field"]): r for r in audit(inp, runs={"plain": False, "repair": True}).filter("doc_id = 1").collect()}
    assert both["plain", "remark"]["kept"] == "Freedonia" and not both["plain", "remark"]["final_ok"]
    assert both["repair", "remark"]["kept"] == "" and both["repair", "remark"]["final_ok"] and both["repair", "remark"]["support"] == 0.0


def test_plan_holds_no_text_behind_the_rows_of_fields(spark):
    """Scores without support read no document text, and the sweep joins nothing but its inputs."""
    inp = _inputs(spark, con=GOLD, unc=GOLD, arb={}, gold=GOLD)
    plan = scored_fields(inp)._jdf.queryExecution().optimizedPlan().toString()
    assert "document#" not in plan.split("Generate")[0] and "Python" not in plan
    rows = CN.canonicalise(X.field_rows(inp.extractions, SCHEMA, inp.answer_book, inp.documents, run_ids=("r",)), SCHEMA, ("con", "unc", "gold"))
    plan = ST.sweep(FL.score(rows, SCHEMA), SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
