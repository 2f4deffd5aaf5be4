"""What keeps disk and time of the audit queries down: one exchange a table at most, one audit a query, no copies."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dualcheck.operators import extract as X
from dualcheck.operators import postings as PO
from dualcheck.operators import studies as ST
from dualcheck.session import materialize_dealt
from dualcheck.sources import runs as RU
from dualcheck.sources.fixtures import order_suppliers
from dualcheck.spec import FieldSpec, Schema

SCHEMA = Schema("s", (FieldSpec("a", "string"), FieldSpec("b", "string", required=False)))


def _tables(spark, runs=("r",), ids=(1, 2, 2, None)):
    docs = spark.createDataFrame([(i, i, f"text {i}", {"a": f"g{i}"}) for i in ids], "doc_id long, doc_idx long, document string, gold map<string,string>")
    ext = spark.createDataFrame([(r, i, '{"a": "%s%d"}' % (r, i), "") for r in (*runs, "other") for i in (1, 3)], "run_id string, doc_id long, constrained_raw string, unconstrained_raw string")
    book = spark.createDataFrame([(r, i, "a", f"arb {r}{i}") for r in (*runs, "other") for i in (1, 2)], "run_id string, doc_id long, field string, raw string")
    return docs, ext, book


def _exchanges(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("runs", [("r",), ("r", "q")])
def test_all_documents_of_each_run_with_answers_and_gold(spark, runs):
    docs, ext, book = _tables(spark, runs)
    rows = X.field_rows(ext, SCHEMA, book, docs, run_ids=runs).filter("field = 'a'")
    got = sorted(((r["run_id"], r["doc_id"] or 0, r["con"], r["gold"], r["arb_raw"]) for r in rows.collect()), key=str)
    want = []
    for r in runs:
        want += [(r, 1, f"{r}1", "g1", f"arb {r}1")]
        want += [(r, 2, "", "g2", f"arb {r}2")] * (2 if len(runs) == 1 else 4)  # a repeated id meets its own rows
        want += [(r, 0, "", "gNone", None)] if len(runs) == 1 else []
    assert got == sorted(want, key=str)


def test_tables_in_buckets_of_the_document_meet_without_a_shuffle(spark):
    docs, ext, book = _tables(spark, ids=range(50))
    whole = materialize_dealt(docs.join(ext.filter("run_id = 'r'"), "doc_id", "left"), "dealt", "doc_id")
    assert whole.count() == 50 and not [t for t in spark.catalog.listTables() if t.name.startswith("dealt")]
    part = whole.select(F.lit("r").alias("run_id"), "doc_id", F.coalesce("constrained_raw", F.lit("")).alias("constrained_raw"), F.lit("").alias("unconstrained_raw"))
    answers = whole.select(F.lit("r").alias("run_id"), "doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("field"), F.lit("x").alias("raw"))
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = X.field_rows(part, SCHEMA, answers, whole.select("doc_id", "doc_idx", "document", "gold"), run_ids=("r",))
        assert "SortMergeJoin" in _exchanges(rows) and "Exchange" not in _exchanges(rows)
        assert rows.filter("arb_raw = 'x'").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)


def test_line_items_are_shuffled_once(spark):
    items = spark.createDataFrame([(o, s) for o in range(20) for s in (o % 3, o % 3, 7)], "l_orderkey long, l_suppkey long")
    names = spark.createDataFrame([(s, f"S{s}") for s in range(8)], "s_suppkey long, s_name string")
    got = order_suppliers(items, F.broadcast(names))
    plan = _exchanges(got)
    assert plan.count("Exchange hashpartitioning") == 1
    assert {r["l_orderkey"]: r["names"] for r in got.collect()} == {o: [f"S{o % 3}", "S7"] for o in range(20)}


def test_the_accuracies_of_a_bootstrap_are_worked_out_once(spark):
    """Means and replicates both read them; and draws of a document are shared, whichever rows stand beside it."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x
    rows = [(r, i, (i * k % 7) / 7) for i in range(200) for k, r in ((1, "p"), (3, "q"))]
    df = spark.createDataFrame(rows, "run_id string, doc_id long, v double").withColumn("final_acc", F.udf(counted, "double")("v"))
    got = {r["run_id"]: r for r in ST.bootstrap_ci(df, n_boot=300, seed=4).collect()}
    assert seen.value == len(rows)
    w = ST.weights(np.arange(200), np.arange(300), 4)
    for k, r in ((1, "p"), (3, "q")):
        v = np.array([(i * k % 7) / 7 for i in range(200)])
        m = np.sort((v @ w) / w.sum(0))
        assert abs(got[r]["lo95"] - m[7]) < 1e-6 and abs(got[r]["hi95"] - m[292]) < 1e-6


def test_harmonic_numbers(spark):
    ns = [0, 1, 2, 19, 20, 21, 22, 1000, 10 ** 6]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", ST.harmonic(F.col("n")).alias("h")).collect()
    for r in got:
        assert abs(r["h"] - math.fsum(1 / i for i in range(1, r["n"] + 1))) < 1e-12


def test_aurc_writes_wrong_places_only(spark, monkeypatch):
    written = []
    own = ST.materialize
    monkeypatch.setattr(ST, "materialize", lambda df, name: written.append((name, own(df, name))) or written[-1][1])
    rows = [("s", float(i % 3), i % 10 == 0, i, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "signal string, score double, wrong boolean, doc_idx long, ord int")
    got = ST.aurc(df, partitions=4).first()
    errors = np.cumsum([r[2] for r in sorted(rows, key=lambda r: (-r[1], r[3]))])
    assert abs(got["aurc"] - float(np.mean(errors / np.arange(1, 201)))) < 1e-6 and got["n"] == 200
    assert [n for n, _ in written] == ["wrong-places"] and written[0][1].filter("place > 0").count() == 20


def test_a_stored_folder_is_adopted_and_not_copied(spark, tmp_path):
    cols = {c: F.lit(None).cast("string") for c in RU.TRACE} | {
        "doc_id": F.col("id"), "doc_idx": F.col("id"), "ord": F.lit(0), "field": F.lit("a"), "final": F.lit("v")} | {
        c: F.lit(True) for c in ("flagged", "confident", "ungrounded", "repaired", "con_ok", "unc_ok", "final_ok", "corrupted", "changed")}
    rows = spark.range(30).select(F.when(F.col("id") < 20, "p").otherwise("q").alias("run_id"), *(c.alias(n) for n, c in cols.items()))
    root, folder = f"{tmp_path}/runs", f"{tmp_path}/a folder/audited-1"
    RU.write_run(rows.filter("run_id = 'p' and doc_id < 3"), SCHEMA, root)
    rows.write.parquet(folder)
    version = RU.adopt_run(spark.read.parquet(folder), SCHEMA, root)
    assert version == "audited-1" and len(list((tmp_path / "runs" / "fields").iterdir())) == 1
    assert {r["run_id"]: r["count"] for r in RU.read_fields(spark, root).groupBy("run_id").count().collect()} == {"p": 20, "q": 10}
    assert {r["run_id"]: r["docs"] for r in RU.read_reports(spark, root).collect()} == {"p": 20, "q": 10}


def test_elements_of_postings_are_worked_out_once(spark, monkeypatch):
    written = []
    own = PO.materialize
    monkeypatch.setattr(PO, "materialize", lambda df, name: written.append(name) or own(df, name))
    docs = spark.createDataFrame([(1, "Alpha sons, two Beta")], "doc_id long, document string")
    rows = spark.createDataFrame([("r", 1, 0, "a", "alpha son gamma 2"), ("r", 1, 1, "b", "")], "run_id string, doc_id long, ord int, field string, final string")
    got = {r["ord"]: r["support"] for r in PO.posting_support(rows, docs, SCHEMA).collect()}
    assert got == {0: 0.75, 1: 1.0} and written == ["value-elements"]
