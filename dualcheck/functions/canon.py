"""Type-aware canonical forms as native Spark column expressions.

Every function maps a string Column to a Column; nothing here leaves the JVM.
Regexes use ``(?U)`` so that ``\\w``, ``\\s`` and ``\\b`` are Unicode-aware, as
Python's are. Absence is the empty string throughout, never NULL.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import FieldSpec

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour for equal results)
# ---------------------------------------------------------------------------
# Phrases meaning "the document does not state this" (optional fields only).
# "-" is listed by the reference but can never match: the punctuation strip
# runs first.
ABSENCE_PHRASES = ("none", "n/a", "na", "null", "not provided", "not specified",
                   "not stated", "not applicable", "not mentioned", "unknown", "-")
# Spelled-out small numbers, replaced token by token in string values.
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
                "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
                "eleven": "11", "twelve": "12"}
# Legal designators, applied to the last token only.
LEGAL_SUFFIX = {"incorporated": "inc", "corporation": "corp", "limited": "ltd",
                "company": "co"}
# Characters and currency codes removed before reading a number.
NUMBER_JUNK = r"(?iU)[$€£₹,\s]|USD|EUR|GBP|INR|MYR|RM"
# Date formats, tried in this order (day/month before month/day).
DATE_FORMATS = ("%Y-%m-%d", "%d %B %Y", "%B %d %Y", "%d/%m/%Y", "%m/%d/%Y",
                "%d-%m-%Y", "%b %d %Y", "%d %b %Y")
MONTHS = ("january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december")
MONTHS_ABBR = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep",
               "oct", "nov", "dec")
# Trailing time of day stripped from date answers; "30th day of" legalese.
TIME_TAIL = r"(?iU)[,\s]*\d{1,2}:\d{2}(:\d{2})?\s*(AM|PM)?\s*$"
ORDINAL_DAY = r"(?iU)\b(\d{1,2})(?:st|nd|rd|th)?\s+day\s+of\s+"
# Runs of whitespace and of punctuation that string values don't keep.
STRING_BREAKS = r"(?U)[^\w&/@-]+"
# The same within a list, whose parts ";" separates.
LIST_BREAKS = r"(?U)[^\w&/@;-]+"
# All characters that \s is under (?U).
WHITESPACE = ("\t\n\u000b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
              + "\u2028\u2029\u202f\u205f\u3000")
# Runs of whitespace.
BLANKS = r"(?U)\s+"
SPACED_TAIL = r"(?U)\b((?:[a-z] )+[a-z])$"
# ---------------------------------------------------------------------------

_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_MON = r"(?:0?[1-9]|1[0-2])"
_FULL = "(?i:" + "|".join(MONTHS) + ")"
_ABBR = "(?i:" + "|".join(MONTHS_ABBR) + ")"
# Python's strptime directive -> (shape gate, Spark pattern). The gate keeps
# Spark from accepting what Python rejects (three-digit days, short years).
_DATE_GATES = {
    "%Y-%m-%d": (rf"^\d{{4}}-{_MON}-{_DAY}$", "yyyy-M-d"),
    "%d %B %Y": (rf"^{_DAY} {_FULL} \d{{4}}$", "d MMMM yyyy"),
    "%B %d %Y": (rf"^{_FULL} {_DAY} \d{{4}}$", "MMMM d yyyy"),
    "%d/%m/%Y": (rf"^{_DAY}/{_MON}/\d{{4}}$", "d/M/yyyy"),
    "%m/%d/%Y": (rf"^{_MON}/{_DAY}/\d{{4}}$", "M/d/yyyy"),
    "%d-%m-%Y": (rf"^{_DAY}-{_MON}-\d{{4}}$", "d-M-yyyy"),
    "%b %d %Y": (rf"^{_ABBR} {_DAY} \d{{4}}$", "MMM d yyyy"),
    "%d %b %Y": (rf"^{_DAY} {_ABBR} \d{{4}}$", "d MMM yyyy"),
}
# What Python's float() accepts once junk is gone (inf/nan excluded: the
# reference cannot print them, we keep them as text).
_FLOAT_SYNTAX = (r"^[+-]?(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)"
                 r"(?:[eE][+-]?\d(?:_?\d)*)?$")


def _absence_regex() -> str:
    one = [p for p in ABSENCE_PHRASES if " " not in p and p != "-"]
    two = [p for p in ABSENCE_PHRASES if " " in p]
    one_re = r"(?:\S+\s+){0,3}(?:" + "|".join(one) + ")"
    two_re = r"(?:\S+\s+){0,2}(?:" + "|".join(p.replace(" ", r"\s+") for p in two) + ")"
    return rf"(?U)^(?:{one_re}|{two_re})$"


_ABSENCE_RE = _absence_regex()


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Column expressions are trees; a Python variable used twice duplicates its
    whole sub-tree in the plan. Passing it through a one-element lambda keeps a
    single copy (the optimizer and code generator see a variable reference).
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def in_script(c: Column, pattern: str, apply: Callable[[Column, str], Column]) -> Column:
    """``apply(c, pattern)`` for ``c`` referenced by name; in texts of ASCII alone with the pattern for ASCII, which finds
    the same there at less cost than Unicode's classes."""
    return F.when(is_ascii(c), apply(c, _ascii_pattern(pattern))).otherwise(apply(c, pattern))


def _ascii_pattern(pattern: str) -> str:
    flags, rest = re.match(r"\(\?(\w*)U\)(.*)", pattern, re.S).groups()
    return (f"(?{flags})" if flags else "") + "".join(x for x in rest if x.isascii())


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove surrounding Unicode whitespace."""
    return F.btrim(c, F.lit(WHITESPACE))


def casefold(c: Column) -> Column:
    """Approximation of ``str.casefold`` (lower case, sharp s expanded)."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def is_absent_text(v: Column) -> Column:
    """N1 for an optional field: value says the document does not state it."""
    cleaned = strip_ws(F.regexp_replace(casefold(strip_ws(v)), r"(?U)[^\w\s/]", ""))
    return cleaned.rlike(_ABSENCE_RE)


def is_absent(spec: FieldSpec, v: Column) -> Column:
    return F.lit(False) if spec.required else is_absent_text(v)


def number_value(v: Column) -> Column:
    """N2 numeric part: DOUBLE or NULL when the text is not a number."""
    return let(number_clean(strip_ws(v)), number_parse)


def number_text(num: Column) -> Column:
    """Printable canonical number: integers without a point, else plain digits.

    ``num`` should be a cheap reference (a column or a bound variable).
    """
    # floor() of a DOUBLE is a LONG in Spark and overflows; a remainder does not.
    integral = (num % F.lit(1.0)) == F.lit(0.0)
    big = F.abs(num) >= F.lit(9.0e18)
    # Java prints 1e7 and above with an exponent; re-print through DECIMAL. Below
    # 1 the shortest Java form is kept (it is exact and plain down to 1e-3).
    plain = F.regexp_replace(
        num.cast("string").try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (F.when(integral & ~big, num.cast("long").cast("string"))
            .when(integral & (F.abs(num) < F.lit(1e38)),
                  num.cast("decimal(38,0)").cast("string"))
            .when(~integral & (F.abs(num) >= F.lit(1.0)),
                  F.coalesce(plain, num.cast("string")))
            .otherwise(num.cast("string")))


def _date_prepared(v: Column) -> Column:
    s = strip_ws(v)
    d = strip_ws(F.when(F.contains(s, F.lit(":")), F.regexp_replace(s, TIME_TAIL, "")).otherwise(s))
    return F.regexp_replace(unordinal(d), BLANKS, " ")


def unordinal(d: Column) -> Column:
    """"30th day of" as "30", and commas dropped."""
    d = F.when(F.contains(F.lower(d), F.lit("day")), F.regexp_replace(d, ORDINAL_DAY, "$1 ")).otherwise(d)
    return F.replace(d, F.lit(","), F.lit(""))


def date_value(v: Column) -> Column:
    """N3 date part: DATE or NULL, formats tried in the fixed order."""
    return let(_date_prepared(v), date_parse)


_NUMWORD_ANY = r"(?:^| )(?:" + "|".join(NUMBER_WORDS) + r")(?: |$)"
# What a part of a prepared list may hold that changes it further: a number word, or at its end a legal designator or
# a letter by itself.
_PART_CHANGES = ("(?:^|[ ;])(?:(?:" + "|".join(NUMBER_WORDS) + ")(?:[ ;]|$)|(?:" + "|".join(LEGAL_SUFFIX) + ")(?:;|$))| [a-z](?:;|$)")


def string_prepared(s: Column) -> Column:
    """Punctuation to spaces, whitespace collapsed, stripped, case-folded."""
    return casefold(F.trim(F.regexp_replace(s, STRING_BREAKS, " ")))


def column_prepared(s: Column) -> Column:
    """``string_prepared`` of a column referenced by name."""
    return casefold(F.trim(in_script(s, STRING_BREAKS, lambda c, p: F.regexp_replace(c, p, " "))))


def number_words(t: Column) -> Column:
    """Whole-token number words -> digits (``t`` is single-space separated).

    Gated by one search so that values without number words pay one regex.
    """
    out = t
    for w, d in NUMBER_WORDS.items():
        out = F.regexp_replace(out, rf"(?<![^ ]){w}(?![^ ])", d)
    return F.when(t.rlike(_NUMWORD_ANY), out).otherwise(t)


def legal_suffix(t: Column) -> Column:
    """Legal designator on the last token -> short form."""
    out = t
    for word, short in LEGAL_SUFFIX.items():
        there = (t == word) | t.endswith(f" {word}")
        out = F.when(there, F.concat(F.substring(t, F.lit(1), F.length(t) - len(word)), F.lit(short))).otherwise(out)
    return out


def tail_of(t: Column) -> Column:
    """The spaced single letters at the end of a prepared text, else "": searched
    for only where a blank stands before its last character."""
    return F.when(F.substring(t, -2, 1) == " ", F.regexp_extract(t, SPACED_TAIL, 1)).otherwise(F.lit(""))


def spaced_tail(t: Column, tail: Column) -> Column:
    """Trailing spaced single letters joined ("l l c" -> "llc"); ``tail`` is ``tail_of(t)``."""
    return F.when(tail == "", t).otherwise(
        F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(tail)),
                 F.replace(tail, F.lit(" "), F.lit(""))))


def string_text(v: Column) -> Column:
    """N4 string/enum canonical text (punctuation, case, number words, suffix).

    Compact form for per-element use; jobs use the staged form in
    ``operators.canonicalise``, which computes each step once, in generated code.
    """
    return let(legal_suffix_let(number_words_let(string_prepared(strip_ws(v)))),
               lambda t: spaced_tail(t, tail_of(t)))


def number_words_let(t: Column) -> Column:
    return let(t, number_words)


def legal_suffix_let(t: Column) -> Column:
    return let(t, legal_suffix)


def number_clean(s: Column) -> Column:
    return F.regexp_replace(s, NUMBER_JUNK, "")


def date_prepared(s: Column) -> Column:
    return _date_prepared(s)


def number_parse(cleaned: Column) -> Column:
    return F.when(cleaned.rlike(_FLOAT_SYNTAX),
                  F.regexp_replace(cleaned, "_", "").try_cast("double") + F.lit(0.0))


def date_parse(d: Column) -> Column:
    def tried(formats):
        return F.coalesce(*[F.when(d.rlike(_DATE_GATES[f][0]), F.try_to_date(d, _DATE_GATES[f][1])) for f in formats])
    # no format with one of these marks reads a text without it, or with the other
    marks = {m: [f for f in DATE_FORMATS if m in f] for m in "/-"}
    out = tried([f for f in DATE_FORMATS if not any(m in f for m in marks)])
    for m, formats in marks.items():
        out = F.when(F.contains(d, F.lit(m)), tried(formats)).otherwise(out)
    return out


CANON_TYPE = "struct<text:string,num:double,dt:date>"


def canon_struct(spec: FieldSpec, v: Column) -> Column:
    """N6 scalar canonical form (the reference ``normalize``) with typed parts.

    ``text``: numbers print through ``number_text``, dates as ISO, unparseable
    numbers/dates fall back to the case-folded value, absent or blank -> "".
    ``num``/``dt``: the typed value, NULL when absent or unparsed.
    """
    def body(s: Column) -> Column:
        empty = (s == "") | is_absent(spec, s)
        null_d, null_n = F.lit(None).cast("date"), F.lit(None).cast("double")
        if spec.numeric:
            def with_num(num):
                return F.struct(
                    F.when(num.isNotNull(), number_text(num)).otherwise(casefold(s)).alias("text"),
                    num.alias("num"), null_d.alias("dt"))
            val = let(number_value(s), with_num)
        elif spec.type == "date":
            def with_dt(dt):
                return F.struct(
                    F.when(dt.isNotNull(), dt.cast("string")).otherwise(casefold(s)).alias("text"),
                    null_n.alias("num"), dt.alias("dt"))
            val = let(date_value(s), with_dt)
        else:
            val = F.struct(string_text(s).alias("text"), null_n.alias("num"), null_d.alias("dt"))
        blank = F.struct(F.lit("").alias("text"), null_n.alias("num"), null_d.alias("dt"))
        return F.when(empty, blank).otherwise(val)
    return let(strip_ws(F.coalesce(v, F.lit(""))), body)


def canon_text(spec: FieldSpec, v: Column) -> Column:
    return canon_struct(spec, v)["text"]


def canon_number(spec: FieldSpec, v: Column) -> Column:
    """Typed numeric canonical value (NULL when absent or unparsed)."""
    return canon_struct(spec, v)["num"]


def canon_date(spec: FieldSpec, v: Column) -> Column:
    """Typed date canonical value (NULL when absent or unparsed)."""
    return canon_struct(spec, v)["dt"]


def listed(spec: FieldSpec) -> bool:
    """Whether a field's values are lists of texts, which ``list_prepared`` can read as a whole."""
    return spec.multi and spec.required and spec.type in ("string", "enum")


def list_prepared(v: Column) -> Column:
    """``string_prepared`` of all ';'-separated parts at once, still separated."""
    s = F.coalesce(in_script(v, LIST_BREAKS, lambda c, p: F.regexp_replace(c, p, " ")), F.lit(""))
    return casefold(F.btrim(F.regexp_replace(s, " ?; ?", ";")))


def canon_set(spec: FieldSpec, v: Column, whole: Column | None = None) -> Column:
    """N5: ';'-separated parts, each canonicalised, blanks dropped, as a sorted set.

    ``whole`` is the column of ``list_prepared(v)`` of a ``listed`` field: where no part holds a number word, a
    legal designator or spaced letters, its parts are the canonical ones.
    """
    parts = F.split(F.coalesce(v, F.lit("")), ";")
    canon = F.transform(parts, lambda p: canon_text(spec, p))
    each = F.array_sort(F.array_distinct(F.filter(canon, lambda x: x != "")))
    if whole is None:
        return each
    plain = F.sort_array(F.array_distinct(F.array_remove(F.split(whole, ";"), "")))
    return F.when(whole.rlike(_PART_CHANGES), each).otherwise(plain)


def canon_key(spec: FieldSpec, v: Column) -> Column:
    """C7 equality key: the set for multi fields, a one-element array otherwise."""
    if spec.multi:
        return canon_set(spec, v)
    return F.array(canon_text(spec, v))
