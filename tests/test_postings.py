"""G4/G5 by postings against the array form, on rendered orders and on whole natural texts."""
from pyspark.sql import functions as F

from dualcheck.operators import canonicalise as CN
from dualcheck.operators import ground as G
from dualcheck.operators import postings as PO
from dualcheck.plans.audit import audit
from dualcheck.sources.fixtures import read_table, tpch_audit_inputs
from dualcheck.spec import FieldSpec, Schema

SF = "/root/testdata/sf0.001"


def test_postings_equal_arrays_on_orders(spark):
    inp = tpch_audit_inputs(spark, SF)
    a = audit(inp).select("run_id", "doc_id", "ord", "final", F.round("support", 9).alias("support")).cache()
    got = PO.posting_support(a, inp.documents, inp.schema).withColumn("support", F.round("support", 9))
    want = a.select("run_id", "doc_id", "ord", "support")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == want.count() > 10_000


def test_postings_equal_arrays_on_whole_documents(spark):
    """Real texts, the longest included: claims from the text itself, from another text, of sizes, of sets and of nothing."""
    schema = Schema("claims", (FieldSpec("quote", "string"), FieldSpec("other", "string"), FieldSpec("size", "number"), FieldSpec("day", "date"), FieldSpec("names", "string", multi=True)))
    docs = read_table(spark, SF, "documents").filter("text is not null").select("doc_id", F.col("text").alias("document"))
    extra = spark.createDataFrame([(-1, "Signed on the 30th day of April, 2009; twelve months, Acme Corp."), (-2, ""), (-3, "due 03/04/2019, total 1,234.50"), (-4, "a1 " * 60_000 + "zz")], docs.schema)
    docs = docs.unionByName(extra)
    words = F.split("document", " ")
    rows = docs.select(F.lit("r").alias("run_id"), "doc_id", F.posexplode(F.array(
        F.array_join(F.slice(words, 3, 6), " "), F.concat(F.lit("zz quelque "), F.array_join(F.slice(F.reverse(words), 1, 3), " ")),
        F.when(F.col("doc_id") == -3, "$1234.5").otherwise(F.length("document").cast("string")), F.when(F.col("doc_id") == -1, "2009-04-30").when(F.col("doc_id") == -3, "03/04/2019").otherwise(""),
        F.concat(F.element_at(words, 1), F.lit("; ;Nobodys;"), F.element_at(words, -1)))).alias("ord", "final"))
    featured = G.document_features(docs).select("doc_id", *G.FEATURES)
    arrays = G.support(CN.staged_canon(rows.join(featured, "doc_id"), schema, "final", "final_c"), schema).select("run_id", "doc_id", "ord", F.round("support", 9).alias("support"))
    got = PO.posting_support(rows, docs, schema).withColumn("support", F.round("support", 9))
    assert got.exceptAll(arrays).isEmpty() and arrays.exceptAll(got).isEmpty()
    assert {r["support"] for r in got.filter("doc_id < 0 and ord in (2, 3)").collect()} >= {0.0, 1.0}


def test_no_text_or_tokens_behind_rows_of_fields(spark):
    inp = tpch_audit_inputs(spark, SF)
    plan = G.evidence(audit(inp), inp.documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "_low" in plan and "document#" not in plan.split("Aggregate")[1].split("Generate")[0]
