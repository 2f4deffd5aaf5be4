"""Source grounding (G1-G6, G9): document features and support of a value.

Document features are computed once per document and carried as arrays; a
value is then checked against them with array functions, never by re-reading
the text per field.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import FieldSpec
from . import canon as N
from .parse import NUMBER_PATTERN

# Date-shaped spans searched in a document (incl. the legalese
# "30th day of April, 2009"), case-insensitive, Unicode word characters.
# Words and blanks are taken whole ("++"): neither begins with what may follow the other.
DATE_SPANS = (r"(?iU)\d{1,2}(?:st|nd|rd|th)?\s++day\s++of\s++\w++,?\s++\d{4}"
              r"|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
              r"|\d{4}-\d{2}-\d{2}"
              r"|\d{1,2}\s++\w{3,9}+,?\s++\d{4}"
              r"|\w{3,9}+\s++\d{1,2},?\s++\d{4}")

_DOC_SPEC = FieldSpec("_doc", "string")
_SEP = "\u0001"


def _rstrip_s(t: Column) -> Column:
    return F.regexp_replace(t, "s+$", "")


def doc_tokens(document: Column) -> Column:
    """G1: canonical tokens of the document plus their forms without trailing s."""
    toks = F.filter(F.split(N.string_text(document), " "), lambda x: x != "")
    return F.array_distinct(F.concat(toks, F.transform(toks, _rstrip_s)))


def doc_numbers(document: Column) -> Column:
    """Every number written in the document, as DOUBLE.

    The pattern is matched on the text as it stands, so "10.50,20" holds 10.5
    and 20; commas are dropped inside each match ("1,234" is 1234). The matches
    are joined for one replacement, as none holds a space.
    """
    raw = F.array_join(F.regexp_extract_all(document, F.lit(NUMBER_PATTERN), 0), " ")
    plain = F.split(F.replace(raw, F.lit(","), F.lit("")), " ")
    return F.array_distinct(F.array_compact(plain.try_cast("array<double>")))


def date_spans(document: Column) -> Column:
    """The date-shaped spans of a document referenced by name."""
    return N.in_script(document, DATE_SPANS, lambda c, p: F.regexp_extract_all(c, F.lit(p), 0))


def doc_dates(document: Column) -> Column:
    """Canonical forms of date-shaped spans in the document."""
    return dates_of(date_spans(document))


def dates_of(spans: Column) -> Column:
    """Canonical forms of ``date_spans``. They begin and end with word characters and hold no time of day, so there is
    nothing to strip; what else is prepared, is so in all of them at once."""
    joined = F.regexp_replace(N.unordinal(F.array_join(spans, _SEP)), N.BLANKS, " ")
    each = F.zip_with(spans, F.split(joined, _SEP), lambda s, d: F.coalesce(N.date_parse(d).cast("string"), N.casefold(s)))
    return F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))


def doc_folded(document: Column) -> Column:
    """Case-folded text, for verbatim containment of date values."""
    return N.casefold(document)


def _all_there(text: Column, tokens: Column) -> Column:
    """Whether each token of a canonical text is one of ``tokens``: by one lookup each, while a share of them costs a
    search through all tokens each."""
    return F.coalesce(F.size(F.array_except(F.split(text, " "), tokens)) == 0, F.lit(False))


def _scalar_body(spec: FieldSpec, value: Column, c: Column, tokens: Column,
                 numbers: Column, dates: Column, folded: Column) -> Column:
    n = c["text"]
    if spec.numeric:
        body = F.when(F.coalesce(F.array_contains(numbers, c["num"]), F.lit(False)),
                      F.lit(1.0)).otherwise(F.lit(0.0))
    elif spec.type == "date":
        verbatim = F.instr(folded, N.casefold(N.strip_ws(value))) > 0
        body = F.when(verbatim | F.array_contains(dates, n), F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        def ratio(toks: Column) -> Column:
            hits = F.size(F.filter(toks, lambda t: F.array_contains(tokens, t)
                                   | F.array_contains(tokens, _rstrip_s(t))))
            return F.when(F.size(toks) == 0, F.lit(1.0)).otherwise(hits / F.size(toks))
        body = F.when(_all_there(n, tokens), F.lit(1.0)).otherwise(N.let(F.filter(F.split(n, " "), lambda x: x != ""), ratio))
    return F.when(n == "", F.lit(1.0)).otherwise(body)


def scalar_support(spec: FieldSpec, value: Column, tokens: Column, numbers: Column,
                   dates: Column, folded: Column, canon: Column | None = None) -> Column:
    """Support in [0, 1] of one scalar value against document features.

    ``canon`` is the value's canon struct when already computed.
    """
    if canon is not None:
        return _scalar_body(spec, value, canon, tokens, numbers, dates, folded)
    return N.let(N.canon_struct(spec, value),
                 lambda c: _scalar_body(spec, value, c, tokens, numbers, dates, folded))


def support(spec: FieldSpec, value: Column, tokens: Column, numbers: Column,
            dates: Column, folded: Column, canon: Column | None = None, key: Column | None = None) -> Column:
    """Multi values take the weakest element; blanks claim nothing (1.0). ``key`` is a multi value's set when
    already computed."""
    if not spec.multi:
        return scalar_support(spec, value, tokens, numbers, dates, folded, canon)

    def each(p: Column) -> Column:
        return N.let(N.canon_struct(spec, p), lambda c: F.struct(
            (c["text"] != "").alias("keep"),
            _scalar_body(spec, p, c, tokens, numbers, dates, folded).alias("s")))
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ";"), each)
    kept = F.filter(parts, lambda x: x["keep"])
    least = N.let(kept, lambda k: F.when(F.size(k) == 0, F.lit(1.0)).otherwise(
        F.array_min(F.transform(k, lambda x: x["s"]))))
    if key is None or spec.numeric or spec.type == "date":
        return least
    return F.when(_all_there(F.array_join(key, " "), tokens), F.lit(1.0)).otherwise(least)


def evidence_span(value: Column, lowered: Column) -> Column:
    """First literal hit of a value (>= 3 chars, in lower case) in a text in lower case as
    STRUCT<start INT (1-based, 0 = none), end INT>."""
    v = N.strip_ws(F.coalesce(value, F.lit("")))
    pos = F.when(F.length(v) >= 3, F.instr(lowered, F.lower(v))).otherwise(F.lit(0))
    return F.struct(pos.alias("start"),
                    F.when(pos > 0, pos + F.length(v) - 1).otherwise(F.lit(0)).alias("end"))
