"""Response parsing: JSON path, free-form path, arbiter answer cleaning."""
from conftest import one
from dualcheck.functions import parse as P
from dualcheck.operators import extract as X
from dualcheck.spec import FieldSpec, Schema

NAMES = ["invoice_id", "total", "currency", "items", "note"]


SCHEMA = Schema("invoice", tuple(FieldSpec(n, "string") for n in NAMES))


def _answers(spark, parse, **raw):
    both = {"constrained_raw": "", "unconstrained_raw": ""} | raw
    df = spark.createDataFrame([("r", 1, both["constrained_raw"], both["unconstrained_raw"])],
                               "run_id string, doc_id long, constrained_raw string, unconstrained_raw string")
    return {r["field"]: r["value"] for r in parse(df, SCHEMA).collect()}


def _json(spark, raw):
    return _answers(spark, X.parse_constrained, constrained_raw=raw)


def test_json_plain_and_duplicates(spark):
    out = _json(spark, '{"invoice_id": "A", "total": 2.50, "items": ["x", 2], "note": null, "invoice_id": "B"}')
    assert out == {"invoice_id": "B", "total": "2.5", "currency": "", "items": "x; 2", "note": "None"}


def test_json_fenced_and_broken(spark):
    assert _json(spark, '```json\n{"currency": "EUR"}\n```')["currency"] == "EUR"
    assert set(_json(spark, '{"currency": "EUR"').values()) == {""}
    assert set(_json(spark, "[1, 2]").values()) == {""}


def test_one_answer_is_one_object(spark):
    for raw in ('{"note": "x"} {"total": "y"}', '{"note": "x"}, {"total": "y"}', '{"note": "x"} and {"total": "y"}', "", "null"):
        assert set(_json(spark, raw).values()) == {""}, raw
    assert _json(spark, 'Here: {"note": "x"} as asked')["note"] == "x"


def test_an_answer_is_read_for_its_keys_once(spark):
    """One reading of the answer says that it is one object and gives its keys, one its values; what it may hold inside
    other text is read where it is none."""
    df = spark.createDataFrame([("r", 1, '{"note": "x"}', "")], "run_id string, doc_id long, constrained_raw string, unconstrained_raw string")
    plan = X._parsed(df, SCHEMA).select("_t", "_k", "_r")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 3
    assert _json(spark, 'Here: {"note": "x", "note": null, "total": 1} as asked') == {"invoice_id": "", "total": "1", "currency": "", "items": "", "note": "None"}


def test_long_numbers_are_written_out(spark):
    assert _json(spark, '{"total": 12345678.5, "items": 123456789, "note": 0.25}') == {
        "invoice_id": "", "total": "12345678.5", "currency": "", "items": "123456789", "note": "0.25"}


def test_freeform_markdown_keys_last_wins(spark):
    raw = "- **Invoice_ID**: INV-9\n* TOTAL: 12.50\n> currency: EUR\nnote: a: b\ncurrency:\n"
    vals = _answers(spark, X.parse_freeform, unconstrained_raw=raw)
    assert vals == {"invoice_id": "INV-9", "total": "12.50", "currency": "", "items": "", "note": "a: b"}


def test_clean_answer(spark):
    num = FieldSpec("total", "number")
    multi = FieldSpec("amounts", "number", multi=True)
    enum = FieldSpec("currency", "enum", enum=("USD", "EUR", "INR"))
    assert one(spark, lambda c: P.clean_answer(num, c), "The total is 9,478.23.") == "9,478.23"
    assert one(spark, lambda c: P.clean_answer(multi, c), "10.50, 20 and 30.") == "10.50; 20; 30"
    assert one(spark, lambda c: P.clean_answer(enum, c), "It is in eur.") == "EUR"
    assert one(spark, lambda c: P.clean_answer(FieldSpec("v", "string"), c), ' "Acme". ') == "Acme"
