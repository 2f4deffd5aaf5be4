"""Canonicalisation: expectations restated from the reference's unit tests."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import one
from dualcheck.functions import canon as N
from dualcheck.functions import ground as G
from dualcheck.functions import parse as P
from dualcheck.spec import FieldSpec

NUM = FieldSpec("total", "number")
DATE = FieldSpec("date", "date")
STR = FieldSpec("vendor", "string")
OPT = FieldSpec("jurisdiction", "string", required=False)
MULTI = FieldSpec("party", "string", multi=True)


@pytest.mark.parametrize("a,b", [("$54.20", "54.2"), ("1,234", "1234"), ("USD 1,234.50", "1234.5")])
def test_numbers_equal(spark, a, b):
    assert one(spark, lambda c: N.canon_text(NUM, c), a) == one(spark, lambda c: N.canon_text(NUM, c), b)


def test_number_forms(spark):
    assert one(spark, lambda c: N.canon_text(NUM, c), "RM 9.00") == "9"
    assert one(spark, lambda c: N.canon_text(NUM, c), "12345678.5") == "12345678.5"
    assert one(spark, lambda c: N.canon_text(NUM, c), "abc") == "abc"
    assert one(spark, lambda c: N.canon_number(NUM, c), "1e20") == 1e20


@pytest.mark.parametrize("raw,iso", [
    ("14 March 2026", "2026-03-14"), ("30th day of April, 2009", "2009-04-30"),
    ("05 MAR 2018 18:24", "2018-03-05"), ("12/25/2018", "2018-12-25"), ("25/12/2018", "2018-12-25"),
    ("2018-3-5", "2018-03-05"), ("Mar 5 2018", "2018-03-05")])
def test_dates(spark, raw, iso):
    assert one(spark, lambda c: N.canon_text(DATE, c), raw) == iso


@pytest.mark.parametrize("raw,out", [("12-01-19", "12-01-19"), ("30/2/2018", "30/2/2018"),
                                     ("April 30,2009", "april 30,2009")])
def test_unparsed_dates_stay_text(spark, raw, out):
    assert one(spark, lambda c: N.canon_text(DATE, c), raw) == out
    assert one(spark, lambda c: N.canon_date(DATE, c), raw) is None


@pytest.mark.parametrize("raw,out", [
    ("two years", "2 years"), ("Acme Corporation", "acme corp"), ("II-VI Incorporated", "ii-vi inc"),
    ("PJM Interconnection L L C", "pjm interconnection llc"), ("  Éclair,  Naïve  ", "éclair naïve")])
def test_strings(spark, raw, out):
    assert one(spark, lambda c: N.canon_text(STR, c), raw) == out


@pytest.mark.parametrize("raw", ["date not provided", "value unknown", "NONE", "N.A.", "n/a"])
def test_absent(spark, raw):
    assert one(spark, lambda c: N.canon_text(OPT, c), raw) == ""


@pytest.mark.parametrize("raw", ["North Carolina", "Arizona", "Indiana", "Montana", "Ghana", "-",
                                 "a b c d e none"])
def test_not_absent(spark, raw):
    assert one(spark, lambda c: N.canon_text(OPT, c), raw) != ""


def test_absence_only_for_optional(spark):
    assert one(spark, lambda c: N.canon_text(STR, c), "none") == "none"


def test_sets(spark):
    a = one(spark, lambda c: N.canon_set(MULTI, c), "Acme Corp; Beta LLC")
    b = one(spark, lambda c: N.canon_set(MULTI, c), "beta llc ; ACME CORP.")
    assert a == b == ["acme corp", "beta llc"]


def test_stripping_takes_all_whitespace_without_a_pattern(spark):
    from pyspark.sql import functions as F
    c = F.col("c")
    assert "regexp" not in str(N.strip_ws(c)).lower()
    chars = spark.range(1, 0x3100).filter("id < 55296").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    text = F.concat("c", F.lit("a"), "c", F.lit("b"), "c", "c")
    assert chars.filter(N.strip_ws(text) != F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).count() == 0
    assert chars.filter(N.strip_ws(text) != text).count() == len(N.WHITESPACE) == 25


def test_tails_and_breaks(spark):
    assert one(spark, N.string_text, "Acme, ; Holdings (L. L. C)") == "acme holdings llc"
    assert one(spark, N.string_text, "x") == "x" and one(spark, N.string_text, " l l") == "ll" and one(spark, N.string_text, "ab l") == "ab l"
    assert one(spark, lambda c: N.canon_text(DATE, c), "30th DAY of April, 2009 14:05") == "2009-04-30"


def test_list_read_as_a_whole_has_the_sets_of_its_parts(spark):
    odd = ["", None, " ; ;; ", "Acme Corp; Beta LLC", "b a ; A b", "Nine Lives;two;x one", "Acme Limited; Limited Acme", "Acme L. L. C.;x y",
           "Été Große ; ; R&D/x @-y", "ΟΔΟΣ;ΟΔΟΣ x", "a\nb;\tc ;c", "Supplier#000000012; Supplier#000000003;supplier 000000012", "company;co", "-;.;_ a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v string")
    x = df.withColumn("whole", N.list_prepared(F.col("v")))
    rows = x.select("v", N.canon_set(MULTI, F.col("v")).alias("each"), N.canon_set(MULTI, F.col("v"), F.col("whole")).alias("fast")).collect()
    assert [(r["v"], r["fast"]) for r in rows] == [(r["v"], r["each"]) for r in rows]
    # plain parts are read without a function of each part
    plain = x.filter(~F.col("whole").rlike(N._PART_CHANGES))
    assert {r["v"] for r in plain.collect()} >= {"", odd[11], odd[8]}


ODD = ["Größe: 5 ﬁ, naïve – x", "plain (ASCII), text\tof 9 May\n2027", "", "  é ", "\x1c a_b\x0b&/@-c;  d ", "Co. Limited", "limited", "unlimited",
       "ÉTÉ company", None, "a b İ", "one‍two incorporated"]


def test_texts_of_ascii_alone_are_read_alike(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ODD)], "i int, v string")
    for pattern in (N.STRING_BREAKS, N.LIST_BREAKS, N.BLANKS, P._LINE, G.DATE_SPANS):
        both = df.select("i", F.regexp_replace("v", pattern, "<>").alias("a"),
                         N.in_script(F.col("v"), pattern, lambda c, p: F.regexp_replace(c, p, "<>")).alias("b"))
        assert [r for r in both.collect() if r["a"] != r["b"]] == []
    both = df.select(N.string_prepared(F.col("v")).alias("a"), N.column_prepared(F.col("v")).alias("b"),
                     N.casefold(N.strip_ws(F.regexp_replace("v", N.STRING_BREAKS, " "))).alias("c"))
    assert [r for r in both.collect() if not r["a"] == r["b"] == r["c"]] == []


def test_legal_designator_of_a_referenced_column(spark):
    df = spark.createDataFrame([("limited",), ("a limited",), ("unlimited",), ("x company y",), ("é corporation",), ("",)], "t string")
    assert [r[0] for r in df.select(N.legal_suffix(F.col("t"))).collect()] == ["ltd", "a ltd", "unlimited", "x company y", "é corp", ""]


def test_dates_of_spans_equal_each_span_alone(spark):
    docs = ["On the 30th  day of April, 2009 and 9 May 2027; 31/12/2020, 12/31/2020 12-01-2021 2020-02-30 2020-2-3.", "no date", "", None,
            "5 Foobar, 2020 and Décembre 5, 2020 or December\n5 2020; 1 mai 2020", "extraordinary 12 2020 3 abcdefghijkl 2020"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(docs)], "i int, v string").withColumn("s", G.date_spans(F.col("v")))
    plain = (r"(?iU)\d{1,2}(?:st|nd|rd|th)?\s+day\s+of\s+\w+,?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"
             r"|\d{1,2}\s+\w{3,9},?\s+\d{4}|\w{3,9}\s+\d{1,2},?\s+\d{4}")
    each = F.array_distinct(F.transform("s", lambda c: N.canon_text(FieldSpec("d", "date"), c)))
    rows = df.select("s", F.regexp_extract_all("v", F.lit(plain), 0).alias("plain"), G.dates_of(F.col("s")).alias("a"), each.alias("b")).collect()
    assert all(r["s"] == r["plain"] and r["a"] == r["b"] for r in rows)
    assert rows[0]["a"][:3] == ["2009-04-30", "2027-05-09", "2020-12-31"]
