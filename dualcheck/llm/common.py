"""Helpers that several operators share."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..session import scratch_path

#: Bytes of text that a task works on at a time inside an Arrow batch.
SLICE_BYTES = 1 << 20


#: A column that no input has.
MARK = "__row_identity"


def identity(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A struct of a row's id and two hashes of id and text, which tells rows with one id apart."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.col(f"`{id_col}`")
    return F.struct(key.alias("id"), F.xxhash64(key, text).alias("key"), F.xxhash64(text, F.lit("text"), key).alias("more"))


def texts_and_ids(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The id, the text (null: empty) and further columns, under fixed names."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)))


def with_id(docs: DataFrame, id_col: str, *fields: tuple[str, DataType]) -> StructType:
    """The schema of results that carry the id column of ``docs``."""
    return StructType([StructField(id_col, docs.schema[id_col].dataType)]
                      + [StructField(name, kind) for name, kind in fields])


_held: dict[tuple, object] = {}


def only_one(make: Callable[..., object], *args) -> object:
    """What ``make`` gives for these arguments, kept by the worker until anything else is asked for: a worker serves
    one operator after the other, and what several keep of the words they saw would add up."""
    key = make.__module__, make.__qualname__, args
    if key not in _held:
        _held.clear()
        _held[key] = make(*args)
    return _held[key]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with one function call per batch; empty batches are skipped."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out
    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column (null: empty)."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back with the same schema: later
    steps neither repeat the work nor depend on the executors that did it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
