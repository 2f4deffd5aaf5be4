"""Columns made from arrays of found spans.

A span is a struct (start, rank, end, kind, ...): positions in code points, the
end exclusive, rank the place of its kind in the order of kinds. Sorting the
structs thus sorts by start, then by kind.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_rank(spans: Column, below: int) -> Column:
    return F.filter(spans, lambda s: s["rank"] < below)


def counted(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def digest(spans: Column, base_kinds: tuple[str, ...]) -> list[Column]:
    """n_<kind> of each base kind, base_sha256 of their spans, and all spans as text."""
    return [*(counted(spans, i).alias(f"n_{k}") for i, k in enumerate(base_kinds)),
            F.sha2(joined(of_rank(spans, len(base_kinds))), 256).alias("base_sha256"), joined(spans).alias("spans")]
