import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dualcheck.llm import pii_patterns
from dualcheck.llm.spans import digest


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def slow_base(text: str) -> list[tuple]:
    """The base kinds by the stated patterns, without shortcuts."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PARTS = ["a.b", "@", "mail7.example.com", ".", "-", " ", "+1 (017) 555-7713", "4736962573099581", "4111 1111 1111 1111", "152.143.123.131", "256.1.1.1", "1.2.3", "007", "+", "9", "\n", "é", "(", ")", "x@y.z"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_base_spans(parts):
    text = "".join(parts)
    assert sorted(x[:3] for x in pii_patterns.base_spans(text)) == slow_base(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "a@" * 100_000, "1 " * 100_000, "+" * 100_000, "1." * 100_000,
                 "a@b.cc," * 50_000, "12345678 " + " " * 300_000 + "12345678", "x" * 300_000 + " 12345678 a@b.cc", "12345;" * 50_000):
        assert pii_patterns.occurrences(text) is not None


CONTEXT = st.lists(st.one_of(st.sampled_from([" ", " " * 90, "\t", "\n", "\x85", "x" * 80, "id", "no.", "a@b.cc", "12345678"]), st.text(max_size=3)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(CONTEXT, CONTEXT)
def test_words_of_a_context_may_be_any_distance_away(left, right):
    """By splitting the whole text at blanks, with no other span near."""
    runs = re.findall(r"[^\x20\x09-\x0D]+", left)
    assert pii_patterns.words_before(left + "#" + right, len(left), 0) == runs[-2:]
    after = re.findall(r"[^\x20\x09-\x0D]+", right)
    assert pii_patterns.word_after(left + "#" + right, len(left) + 1, len(left) + 1 + len(right)) == (after[0] if after else "")


def test_words_that_touch_a_span_end_at_the_next_one():
    text = "mail to:a@b.cc,c@d.ee;x now"
    assert pii_patterns.words_before(text, 8, 0) == ["mail", "to:"] and pii_patterns.words_before(text, 15, 14) == [","]
    assert pii_patterns.word_after(text, 14, 15) == "," and pii_patterns.word_after(text, 21, len(text)) == ";x"
    assert pii_patterns.words_before("a@b.cc c", 7, 6) == ["a@b.cc"] and pii_patterns.words_before("ab", 2, 2) == []


def test_far_contexts_discover_identifiers(spark):
    """Words in front of 70 and of 500 blanks, a word longer than any window, and Unicode blanks inside a token."""
    gap = lambda n: "reach me at" + " " * n
    rows = [(i, f"{gap(1 + 80 * (i % 3))}u{i}@mail.example.com today") for i in range(30)]
    rows += [(100, gap(70) + "id-4471-9932"), (101, gap(500) + "id-4471-9933"), (102, "y" * 90 + " at\t" + "id-4471-9934"), (103, "far id-4471-9935")]
    found = pii_patterns.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: [(s["kind"], s["end"] - s["start"]) for s in r["spans"]] for r in found}
    assert got[100] == got[101] == got[102] == [("ident", 12)] and got[103] == []


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"my line is reach me at u{i}@mail.example.com today", "s") for i in range(30)]
    rows += [(100, "and you can reach me at id-4471-9932 today", "s"), (101, "total 48812 units sold", "s"), (102, None, None), (103, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("seed", F.lit(1))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii_patterns.find_personal_data(docs).collect()}
    assert got[100] == [("ident", 24, 36)] and got[101] == [] and got[102] == [] and got[103] == []
    assert all([k for k, _, _ in got[i]] == ["email"] for i in range(30)) and len(got) == len(rows)


def test_awkward_rows(clashing, rows, no_docs):
    found = pii_patterns.find_personal_data(clashing).select("doc_id", *digest(F.col("spans"), pii_patterns.KINDS))
    assert found.count() == len(rows)
    assert pii_patterns.find_personal_data(no_docs).count() == 0
