"""Disagreement scores, flags and equality (C1-C7) as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import FieldSpec
from . import canon as N


def token_jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |A∩B|/|A∪B| over whitespace tokens of two canonical texts."""
    ta = F.array_distinct(F.filter(F.split(a, " "), lambda x: x != ""))
    tb = F.array_distinct(F.filter(F.split(b, " "), lambda x: x != ""))
    union = F.size(F.array_union(ta, tb))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.size(F.array_intersect(ta, tb)) / union)


def set_distance(sa: Column, sb: Column) -> Column:
    """C4: equal sets 0, one side empty 1, else 1 - set Jaccard."""
    return (F.when(sa == sb, F.lit(0.0))
            .when((F.size(sa) == 0) | (F.size(sb) == 0), F.lit(1.0))
            .otherwise(F.lit(1.0) - F.size(F.array_intersect(sa, sb))
                       / F.size(F.array_union(sa, sb))))


def numeric_grade(x: Column, y: Column) -> Column:
    """0.5 + 0.5*min(1, relative difference); unparsed -> 1."""
    rel = F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y)))
    return F.when(x.isNull() | y.isNull(), F.lit(1.0)).otherwise(
        F.lit(0.5) + F.lit(0.5) * F.least(F.lit(1.0), F.coalesce(rel, F.lit(0.0))))


def date_grade(x: Column, y: Column) -> Column:
    """0.5 + 0.5*min(1, days/365); unparsed -> 1."""
    return F.when(x.isNull() | y.isNull(), F.lit(1.0)).otherwise(
        F.lit(0.5) + F.lit(0.5) * F.least(F.lit(1.0), F.abs(F.datediff(x, y)) / F.lit(365.0)))


def graded(spec: FieldSpec, a: Column, b: Column, ka: Column, kb: Column) -> Column:
    """C5 from canonical parts: ``a``/``b`` are canon structs (text, num, dt),
    ``ka``/``kb`` the equality keys (sets for multi fields)."""
    if spec.multi:
        return set_distance(ka, kb)
    if spec.type == "string":
        body = token_jaccard_distance(a["text"], b["text"])
    elif spec.numeric:
        body = numeric_grade(a["num"], b["num"])
    elif spec.type == "date":
        body = date_grade(a["dt"], b["dt"])
    else:
        body = F.lit(1.0)
    return F.when(a["text"] == b["text"], F.lit(0.0)).otherwise(body)


def flag_score(spec: FieldSpec, a: Column, b: Column, ka: Column, kb: Column) -> Column:
    """C6 score: 1.0 for a suspicious empty side, else the graded disagreement.

    Emptiness reads the scalar canonical text, also for multi fields (as the
    reference does).
    """
    ea, eb = a["text"] == "", b["text"] == ""
    empty_flag = F.lit(spec.required) | (ea != eb)
    return (F.when(ea | eb, F.when(empty_flag, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(graded(spec, a, b, ka, kb)))


def is_flagged(spec: FieldSpec, na: Column, nb: Column, score: Column,
               threshold: Column | float) -> Column:
    """Required-empty or one-sided empty always; else score >= threshold."""
    ea, eb = na == "", nb == ""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.when(ea | eb, F.lit(spec.required) | (ea != eb))
            .otherwise(score >= thr))


def same(ka: Column, kb: Column) -> Column:
    """Canonical equality on keys built by ``canon.canon_key``."""
    return ka == kb
