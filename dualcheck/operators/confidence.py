"""Per-field confidence (K1) and review-budget selection (K2)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

# Resolution bands.
SOURCE_WEIGHT = {"agreement": 1.0, "majority": 0.7, "split-kept": 0.3}


def confidence(df: DataFrame, resolution: str = "resolution", support: str = "support") -> DataFrame:
    """K1: band x (0.5 + 0.5 x support), support taken before any repair."""
    band = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHT.items() for x in kv]),
                        F.col(resolution))
    return df.withColumn("confidence", band * (F.lit(0.5) + F.lit(0.5) * F.col(support)))


def review_share(df: DataFrame, share: float) -> DataFrame:
    """K2: the least trustworthy ``share`` of all fields of a run goes to review
    (rounded up), the rest is kept; ties break by corpus order (doc_idx, ord).

    Adds ``route``. Fields of each confidence are counted first: the counts say
    which values go to review as a whole, and how many fields of the value at
    the border. Only among those the order is needed: they are counted by
    document, and a window over the border document's few fields does the rest.
    """
    at_value = Window.partitionBy("run_id").orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1)
    per_value = df.groupBy("run_id", "confidence").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("run_id"))
    border = (per_value.select("run_id", F.col("confidence").alias("_border"), "_n", F.coalesce(F.sum("_n").over(at_value), F.lit(0)).alias("_below"),
                               F.ceil(total * F.lit(share)).alias("_quota"))
              .filter((F.col("_below") < F.col("_quota")) & (F.col("_below") + F.col("_n") >= F.col("_quota"))))
    marked = df.join(F.broadcast(border), "run_id", "left")  # a row per run
    tied = marked.filter("confidence = _border")
    per_doc = tied.groupBy("run_id", "doc_idx").agg(F.count("*").alias("_here"), F.first("_quota").alias("_quota"), F.first("_below").alias("_below"))
    ranked = running_total(per_doc, ["run_id", "doc_idx"], "run_id", "_here", "_ahead")
    last = ranked.filter((F.col("_below") + F.col("_ahead") < F.col("_quota")) & (F.col("_below") + F.col("_ahead") + F.col("_here") >= F.col("_quota")))
    last = last.select("run_id", F.col("doc_idx").alias("_last"), (F.col("_quota") - F.col("_below") - F.col("_ahead")).alias("_take"))
    # the border document of each run, of whose tied fields the first few go: at most a document's fields a run
    edge = tied.join(F.broadcast(last), (tied["run_id"] == last["run_id"]) & (F.col("doc_idx") == F.col("_last"))).drop(last["run_id"])
    edge = edge.withColumn("_place", F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))).filter("_place <= _take")
    edge = edge.select("run_id", "doc_idx", "ord", F.lit(True).alias("_edge"))
    out = marked.join(F.broadcast(last), "run_id", "left").join(F.broadcast(edge), ["run_id", "doc_idx", "ord"], "left")
    at_border = F.col("confidence") == F.col("_border")
    review = (F.col("confidence") < F.col("_border")) | (at_border & ((F.col("doc_idx") < F.col("_last")) | F.col("_edge").isNotNull()))
    return out.withColumn("route", F.when(F.coalesce(review, F.lit(False)), F.lit("review")).otherwise(F.lit("keep"))) \
        .drop("_border", "_n", "_below", "_quota", "_last", "_take", "_edge")


def running_total(df: DataFrame, order: list[str], group: str, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the group that come before, in ``order``.

    Rows are ranges of the order, written once; one sum per range and group is
    carried over to the later ranges.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "running-total")
    sums = ranged.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(group, "_range").orderBy(*[c for c in order if c != group]).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(sums), [group, "_range"])
            .withColumn(out, F.col("_carried") + F.col("_inside")).drop("_range", "_carried", "_inside"))
