"""Canonicalisation job (N1-N7) on the long field table.

Adds, for each value column present (con, unc, gold, arb): ``<c>_n`` the scalar
canonical text (the reference ``normalize``), and ``<c>_key`` the equality key
(a set for multi fields). Typed forms (``<c>_num`` DOUBLE, ``<c>_dt`` DATE) are
added on request for reports that return numbers and dates as typed values.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon as N
from ..functions.fields import by_field, fence
from ..spec import FieldSpec, Schema

VALUE_COLUMNS = ("con", "unc", "gold", "arb")


def _null(t: str):
    return F.lit(None).cast(t)


def _kind(f: FieldSpec) -> str:
    return "number" if f.numeric else "date" if f.type == "date" else "text"


def staged_canon(df: DataFrame, schema: Schema, src: str, out: str) -> DataFrame:
    """Adds ``out`` = canon struct (text, num, dt) of column ``src``."""
    return staged_canons(df, schema, {out: F.col(src)})


def staged_canons(df: DataFrame, schema: Schema, values: dict[str, Column]) -> DataFrame:
    """Adds each ``out`` of ``values`` = canon struct (text, num, dt) of its column.

    Each intermediate (stripped text, cleaned number, prepared date, prepared
    string, ...) is its own column referenced by name in the next projection, so
    it is computed once, in generated code. All values take a step in one
    projection, as every projection copies the row.
    """
    def step(df: DataFrame, parts: tuple[str, ...], fn) -> DataFrame:
        return df.select("*", *(e.alias(f"_{out}_{x}") for out in values for x, e in zip(parts, fn(lambda part, out=out: F.col(f"_{out}_{part}")))))

    df = df.select("*", *(N.strip_ws(F.coalesce(v, F.lit(""))).alias(f"_{out}_s") for out, v in values.items()))
    df = step(df, ("abs", "nc", "dp", "sp"), lambda c: (
        by_field(schema, lambda f: F.lit(False) if f.required else N.is_absent_text(c("s")), by=lambda f: f.required),
        by_field(schema, lambda f: N.number_clean(c("s")) if f.numeric else _null("string"), by=_kind),
        by_field(schema, lambda f: N.date_prepared(c("s")) if f.type == "date" else _null("string"), by=_kind),
        by_field(schema, lambda f: N.column_prepared(c("s")) if _kind(f) == "text" else _null("string"), by=_kind)))
    df = step(df, ("num", "dt", "sw"), lambda c: (N.number_parse(c("nc")), N.date_parse(c("dp")), N.number_words(c("sp"))))
    df = step(df, ("sx",), lambda c: (N.legal_suffix(c("sw")),))
    df = step(df, ("tl",), lambda c: (N.tail_of(c("sx")),))

    def struct(out: str) -> Column:
        s, absent, num, dt, sx, tl = (F.col(f"_{out}_{x}") for x in ("s", "abs", "num", "dt", "sx", "tl"))
        text = by_field(schema, lambda f: (
            F.when(num.isNotNull(), N.number_text(num)).otherwise(N.casefold(s)) if f.numeric else
            F.when(dt.isNotNull(), dt.cast("string")).otherwise(N.casefold(s)) if f.type == "date" else
            N.spaced_tail(sx, tl)), by=_kind)
        empty = (s == "") | absent
        return F.struct(
            F.when(empty, F.lit("")).otherwise(text).alias("text"),
            F.when(empty, _null("double")).otherwise(num).alias("num"),
            F.when(empty, _null("date")).otherwise(dt).alias("dt"))
    df = df.withColumns({out: struct(out) for out in values})
    return fence(df.drop(*(f"_{out}_{x}" for out in values for x in ("s", "abs", "nc", "dp", "sp", "num", "dt", "sw", "sx", "tl"))))


def prepared_list(schema: Schema, src: str, wanted: Column):
    """``_<src>_list``: of a multi field the text of ``src`` prepared as a whole, where ``wanted``; read by ``equality_key``."""
    whole = by_field(schema, lambda f: F.when(wanted, N.list_prepared(F.col(src))).otherwise("") if N.listed(f) else _null("string"), by=N.listed)
    return whole.alias(f"_{src}_list")


def equality_key(schema: Schema, src: str):
    """The set of a multi field, else the canonical text alone; ``prepared_list`` comes a projection before."""
    return by_field(schema, lambda f: N.canon_set(f, F.col(src), F.col(f"_{src}_list") if N.listed(f) else None) if f.multi
                    else F.array(F.col(f"{src}_c.text")), by=lambda f: f[1:] if f.multi else None)


def canonicalise(df: DataFrame, schema: Schema, columns: tuple[str, ...] | None = None,
                 typed: bool = False) -> DataFrame:
    """Adds ``<c>_c`` (canon struct), ``<c>_n`` (text) and ``<c>_key`` per value
    column; with ``typed`` also ``<c>_num``, ``<c>_dt`` and ``<c>_disp``."""
    cols = [c for c in (columns or VALUE_COLUMNS) if c in df.columns]
    first, rest = cols[0], cols[1:]
    same = lambda c: F.col(c).eqNullSafe(F.col(first))
    # a value that equals the first takes its form: paths mostly agree, and an empty text passes the patterns at next to no cost
    own = {f"{first}_c": F.col(first)} | {f"_{c}_own": F.when(same(c), F.lit("")).otherwise(F.col(c)) for c in rest}
    out = df.select("*", *(prepared_list(schema, c, F.lit(True) if c == first else ~same(c)) for c in cols))
    out = staged_canons(out, schema, own)
    out = out.withColumns({f"{c}_c": F.when(same(c), F.col(f"{first}_c")).otherwise(F.col(f"_{c}_own")) for c in rest}).drop(*(f"_{c}_own" for c in rest))
    out = out.select("*", F.col(f"{first}_c.text").alias(f"{first}_n"), equality_key(schema, first).alias(f"{first}_key"))
    keys = [x for c in rest for x in (F.col(f"{c}_c.text").alias(f"{c}_n"), F.when(same(c), F.col(f"{first}_key")).otherwise(equality_key(schema, c)).alias(f"{c}_key"))]
    out = out.select("*", *keys).drop(*(f"_{c}_list" for c in cols))
    if typed:
        out = out.select("*", *[x for c in cols for x in (
            F.col(f"{c}_c.num").alias(f"{c}_num"), F.col(f"{c}_c.dt").alias(f"{c}_dt"),
            by_field(schema, lambda s, c=c: F.array_join(F.col(f"{c}_key"), "; ") if s.multi
                     else F.col(f"{c}_n")).alias(f"{c}_disp"))])
    return fence(out)


def absent(df: DataFrame, schema: Schema, column: str = "con") -> DataFrame:
    """N1 as a column: value reads as 'not stated' on an optional field."""
    v = F.col(column)
    return df.withColumn(f"{column}_absent", by_field(schema, lambda s: N.is_absent(s, v)))
