"""Per-field dispatch for long (one row per field) tables.

A schema has a handful of fields and is known when the plan is built, so a
per-row expression is a CASE over the field's ordinal whose branches are
specialised to the field's declared type. Fields with the same signature share
one branch, so the generated code grows with the number of distinct
signatures, not with the number of fields.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import FieldSpec, Schema


def _signature(f: FieldSpec):
    return (f.type, f.required, f.multi, f.enum)


def by_field(schema: Schema, fn: Callable[[FieldSpec], Column],
             ord_col: str = "ord", by: Callable[[FieldSpec], object] = _signature) -> Column:
    """``by`` names what of a field ``fn`` depends on: fields alike in it share a branch."""
    groups: dict = {}
    for i, f in enumerate(schema.fields):
        groups.setdefault(by(f), (f, []))[1].append(i)
    expr = None
    ordc = F.col(ord_col)
    for rep, ords in groups.values():
        cond = ordc == ords[0] if len(ords) == 1 else ordc.isin(*ords)
        expr = F.when(cond, fn(rep)) if expr is None else expr.when(cond, fn(rep))
    return expr


def field_attr(schema: Schema, attr: str, ord_col: str = "ord") -> Column:
    """Static field attribute (required, multi, type, ...) as a column."""
    vals = [getattr(f, attr) for f in schema.fields]
    return F.element_at(F.array(*[F.lit(v) for v in vals]), F.col(ord_col) + 1)


def fenced_filter(df, condition: Column):
    """Filter on computed columns without the optimizer inlining them.

    Catalyst pushes a filter below the projections that define its columns by
    substituting their expressions, which copies (and re-evaluates) whole
    canonicalisation trees. A cheap non-deterministic column in the projection
    under the filter stops that push; the filter then reads the computed value.
    """
    fenced = df.withColumn("_fence", F.spark_partition_id())
    return fenced.filter(condition & (F.col("_fence") >= 0)).drop("_fence")


def fence(df, ord_col: str = "ord"):
    """End an expensive stage: later filters are not pushed below this point.

    ``ord`` is re-defined with a zero-valued non-deterministic term. Every later
    per-field expression reads ``ord``, so the optimizer can neither prune this
    projection nor push a filter through it (which would substitute, and
    re-evaluate, the stage's expressions inside the filter).
    """
    return df.withColumn(ord_col, F.col(ord_col) + F.least(F.spark_partition_id(), F.lit(0)))
