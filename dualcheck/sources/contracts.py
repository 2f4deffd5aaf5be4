"""Contracts from a TSV file whose quoted fields may hold line ends, read by many tasks.

Where a record starts depends on all quotes before it, which is why Spark reads
such a file whole, in one task. But whether a line leaves a quoted field open
depends on its own text and on one bit, whether it begins inside of one. A line
is thus one of four functions of a bit, and these can be chained in any
grouping: over the lines of a split, then over the splits of a file. The bit
before every line follows, records start where it is 0, and their numbers are
counts, chained the same way. Only then a record's lines are brought together.
"""
from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, small_or_dealt
from . import corpus as C

#: What stands in a quoted field after its first quote, and up to its last one.
_INSIDE = re.compile('(?:[^"]|"")*+')
_PLAIN = re.compile("[^\t]*")


def leaves_open(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside of one or not.

    A quote opens a field only as its first character; what follows the closing
    quote up to the tab is plain.
    """
    at = 0
    while True:
        if inside or line.startswith('"', at):
            at = _INSIDE.match(line, at if inside else at + 1).end()
            if at >= len(line):
                return True
            at += 1
        inside = False
        at = _PLAIN.match(line, at).end() + 1
        if at > len(line):
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place and what they make of both bits."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            ends = [[int(leaves_open(t, bit)) for t in texts] if any('"' in t for t in texts) else [int(bit)] * len(texts) for bit in (False, True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int32()) for x in ends)], ["value", *C.PLACE, "from_out", "from_in"])
    return C.file_lines(spark, path).mapInArrow(run, "value string, _file string, _split long, _id long, from_out int, from_in int")


def _chained(rows: DataFrame, keys: list[str], order: list[str], start: Column, out: str) -> DataFrame:
    """``out``: the bit before each row of the group of ``keys``, in ``order``, where the first row has ``start``.

    It is what the last row before says that says the same of both bits, flipped as
    often as later rows flip it.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    flip = F.when((F.col("from_out") == 1) & (F.col("from_in") == 0), 1).otherwise(0)
    rows = rows.withColumn("_flips", F.sum(flip).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("bit"), F.col("_flips").alias("flips")))
    rows = rows.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(upto)).withColumn("_passed", F.coalesce(F.max("_flips").over(upto), F.lit(0)))
    return rows.withColumn(out, F.pmod(F.coalesce("_fixed.bit", start) + F.col("_passed") - F.coalesce("_fixed.flips", F.lit(0)), F.lit(2))).drop("_flips", "_fixed", "_passed")


def quoted_records(spark: SparkSession, path: str, column: int) -> DataFrame:
    """(place, value): column ``column`` (from 0) of the records of a TSV file or a folder of them, in order from place 0.

    Quotes are doubled inside quoted fields; lines end at LF, CR or both. A record with fewer columns raises, as
    does a quote that is never closed. Files are read in the order of their paths; no record spans two.
    """
    lines = materialize(_lines(spark, path), "tsv-lines")
    in_split = ["_file", "_split"]
    # a split as a function of the bit: both ends of it
    both = _chained(_chained(lines.select(*C.PLACE, "from_out", "from_in"), in_split, ["_id"], F.lit(0), "_b0"), in_split, ["_id"], F.lit(1), "_b1")
    end = lambda b: F.max_by(F.when(F.col(b) == 1, F.col("from_in")).otherwise(F.col("from_out")), "_id")
    starts = lambda b: F.count_if(F.col(b) == 0)
    splits = materialize(both.groupBy(*in_split).agg(end("_b0").alias("from_out"), end("_b1").alias("from_in"), starts("_b0").alias("n0"), starts("_b1").alias("n1")), "tsv-splits")
    known = _chained(splits, ["_file"], ["_split"], F.lit(0), "_bit").withColumn("n", F.when(F.col("_bit") == 1, F.col("n1")).otherwise(F.col("n0")))
    known = materialize(known, "tsv-bits")
    files = known.groupBy("_file").agg(F.sum("n").alias("n"), F.max_by(F.when(F.col("_bit") == 1, F.col("from_in")).otherwise(F.col("from_out")), "_split").alias("open"))
    open_ = [r["_file"] for r in files.filter("open = 1").limit(3).collect()]
    if open_:
        raise ValueError(f"a quote is never closed in {', '.join(open_)}")
    files = files.select("_file", F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_of_files"))
    inside = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = known.join(files, "_file").select(*in_split, F.col("_bit").alias("_start"), (F.col("_of_files") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("_before"))
    placed = lines.join(small_or_dealt(materialize(offsets, "tsv-offsets")), in_split)
    bits = _chained(placed, in_split, ["_id"], F.col("_start"), "_bit")
    upto = Window.partitionBy(*in_split).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = bits.withColumn("place", F.col("_before") + F.sum(F.when(F.col("_bit") == 0, 1).otherwise(0)).over(upto) - 1)
    whole = numbered.groupBy("place").agg(F.array_sort(F.collect_list(F.struct(*C.PLACE, "value"))).alias("x"))
    texts = whole.select("place", F.array_join(F.transform("x", lambda r: r["value"]), "\n").alias("record"))

    def cell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            out = []
            for place, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = next(csv.reader(io.StringIO(record, newline=""), delimiter="\t"), [])
                if len(row) <= column:
                    raise ValueError(f"record {place} of {path} has {len(row)} columns, not {column + 1}")
                out.append(row[column])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["place", "value"])
    return texts.mapInArrow(cell, "place long, value string")


def read_contracts(spark: SparkSession, texts: str, labels: str, scalars: tuple[str, ...], list_key: str, column: int = 5) -> DataFrame:
    """(doc_idx, document, gold): contracts from a TSV file (the text in one column) and a file with one line of
    labels per record, paired by their places; what either has more is left out. Literal escapes are undone before
    anything else reads the text."""
    lines = C.numbered_lines(C.file_lines(spark, labels), "doc_id").withColumnRenamed("value", "line")
    parsed = C.parse_label_lines(lines, scalars, list_key)
    gold = F.create_map(*(x for k in (*scalars, list_key) for x in (F.lit(k), F.col(k)))).alias("gold")
    docs = quoted_records(spark, texts, column).select(F.col("place").alias("doc_idx"), C.unescape(F.col("value")).alias("document"))
    return docs.join(parsed.select(F.col("doc_id").alias("doc_idx"), gold), "doc_idx")
