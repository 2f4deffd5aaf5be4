"""Support of values by postings (G4, G5): the form for long documents.

The array form carries a document's tokens into each of its fields' rows and
looks through them. Here a document becomes rows of its own, one per distinct
token, number and date, and so do the values' tokens; whether a token occurs is
an equi-join on document and token. No row holds more than one token, so the
tokens of one long document, or one token of all documents, spread over tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon as N
from ..functions import ground as G
from ..functions.fields import by_field, fenced_filter
from ..session import materialize
from ..spec import Schema
from . import canonicalise as CN
from .ground import canonical_text, distinct_tokens

KEY = ["run_id", "doc_id", "ord"]


def token_postings(documents: DataFrame) -> DataFrame:
    """G1: (doc_id, token): the canonical tokens of every document and their forms without trailing s, each once."""
    return _tokens(documents).distinct()


def _tokens(documents: DataFrame) -> DataFrame:
    """``token_postings``, each once for every row of ``documents``: all that a semi join needs, without a shuffle."""
    return canonical_text(documents).select("doc_id", F.explode(distinct_tokens(F.col("_text"))).alias("token"))


def number_postings(documents: DataFrame) -> DataFrame:
    """(doc_id, number): every number written in a document, once."""
    return documents.select("doc_id", F.explode(G.doc_numbers(F.col("document"))).alias("number")).distinct()


def date_postings(documents: DataFrame) -> DataFrame:
    """(doc_id, date): canonical forms of date-shaped spans, once."""
    spans = documents.select("doc_id", G.date_spans(F.col("document")).alias("_spans"))
    return spans.select("doc_id", F.explode(G.dates_of(F.col("_spans"))).alias("date")).distinct()


def _elements(rows: DataFrame, schema: Schema, value: str) -> DataFrame:
    """One row per element of a value (a scalar is one), with its canonical form; empty ones claim nothing and go."""
    v = F.coalesce(F.col(value), F.lit(""))
    kind = by_field(schema, lambda s: F.lit("number" if s.numeric else "date" if s.type == "date" else "text"))
    parts = by_field(schema, lambda s: F.split(v, ";") if s.multi else F.array(v))
    each = rows.select(*KEY, kind.alias("kind"), F.posexplode(parts).alias("j", "part"))
    each = CN.staged_canon(each, schema, "part", "c").select(*KEY, "kind", "j", "part", "c.text", "c.num")
    return fenced_filter(each, F.col("text") != "")


def posting_support(rows: DataFrame, documents: DataFrame, schema: Schema, value: str = "final") -> DataFrame:
    """(run_id, doc_id, ord, support) of every row's ``value`` against its document.

    Equal to the array form: of a text the share of its tokens that occur, as they
    are or without trailing s; a number or a date occurs or not, a date also
    verbatim; of several elements the least. A value that claims nothing has 1.
    """
    e = materialize(_elements(rows, schema, value), "value-elements")  # read six times below
    # postings are never broadcast: an estimate from the size of the documents' files says little of what they hold
    words = e.filter("kind = 'text'").select(*KEY, "j", F.posexplode(F.split("text", " ")).alias("i", "t")).filter("t <> ''")
    forms = words.select(*KEY, "j", "i", F.explode(F.array_distinct(F.array("t", F.regexp_replace("t", "s+$", "")))).alias("token"))
    known = forms.join(_tokens(documents).hint("merge"), ["doc_id", "token"], "left_semi").select(*KEY, "j", "i").distinct()
    share = (words.groupBy(*KEY, "j").agg(F.count("*").alias("of"))
             .join(known.groupBy(*KEY, "j").agg(F.count("*").alias("hits")), [*KEY, "j"], "left")
             .select(*KEY, (F.coalesce("hits", F.lit(0)) / F.col("of")).alias("s")))
    hit = lambda df, of: of.select(*KEY, "j").join(df.select(*KEY, "j", F.lit(1.0).alias("s")).distinct(), [*KEY, "j"], "left").select(*KEY, F.coalesce("s", F.lit(0.0)).alias("s"))
    numbers = e.filter("kind = 'number'")
    counted = hit(numbers.join(number_postings(documents).withColumnRenamed("number", "num").hint("merge"), ["doc_id", "num"], "left_semi"), numbers)
    dates = e.filter("kind = 'date'")
    spans = dates.join(date_postings(documents).withColumnRenamed("date", "text").hint("merge"), ["doc_id", "text"], "left_semi")
    # a date that stands there word for word: each document meets the few of its values that no span gives
    rest = dates.join(spans.select(*KEY, "j"), [*KEY, "j"], "left_anti")
    verbatim = rest.join(documents.select("doc_id", "document"), "doc_id").filter(F.instr(G.doc_folded(F.col("document")), N.casefold(N.strip_ws(F.col("part")))) > 0)
    dated = hit(spans.select(*KEY, "j").unionByName(verbatim.select(*KEY, "j")), dates)
    least = share.unionByName(counted).unionByName(dated).groupBy(*KEY).agg(F.min("s").alias("support"))
    return rows.select(*KEY).join(least, KEY, "left").select(*KEY, F.coalesce("support", F.lit(1.0)).alias("support"))
