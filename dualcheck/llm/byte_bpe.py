"""Byte-level BPE by overlapping chunks, and decoding.

A pattern splits a text into pre-tokens, each of which is encoded by itself:
its bytes are joined pair by pair, the pair of least rank first. Where a
pre-token ends depends only on the text from its start on, and on a few
characters after its end. So a long text is cut into chunks that overlap, and
every chunk is pre-tokenised by itself, in any task. Its pre-tokens may be wrong
at first, as it starts anywhere, but from the first boundary that it shares
with the chunk before they are those of the whole text. That boundary is
looked for in the overlap by a join of neighbours; chunks without one (a
pre-token is longer than the overlap) become one chunk and are split again,
until every neighbour agrees. Then each chunk's own pre-tokens are encoded,
again in any task, and a document's ids are put together in order. Decoding
joins the bytes of the ids.

The pattern must match every character and look at most ``LOOKAHEAD``
characters beyond what it matches.
"""
from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .backtrack_bpe import Kept
from .common import slices, texts_and_ids, with_id, written

#: Code points of a chunk, and how many of them the next chunk has too.
CHUNK, OVERLAP = 1 << 16, 256
#: A boundary this near to the end of a chunk may depend on what follows there.
LOOKAHEAD = 4
#: Pre-tokens that a task keeps in each of two generations.
CACHED = 300_000
#: Longer pre-tokens are merged with a heap.
SHORT = 48


class Encoder:
    """Encodes by a file of ranks and a pattern like the file's own library, without special tokens, and decodes."""

    def __init__(self, path: str, pattern: str, cached: int = CACHED):
        import regex
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the ranks lack a byte")
        self.token = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.kept = Kept(self.encode_piece, cached)

    def merge_few(self, piece: bytes) -> list[bytes]:
        """The parts of a piece, by looking for the best pair each time."""
        rank = self.ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        joint = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while (known := [r for r in joint if r is not None]):
            at = joint.index(min(known))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at:
                joint[at - 1] = rank(parts[at - 1] + parts[at])
            if at < len(joint):
                joint[at] = rank(parts[at] + parts[at + 1])
        return parts

    def merge_many(self, piece: bytes) -> list[bytes]:
        """The same with a heap of pairs and links to neighbours, for long pieces."""
        rank, n = self.ranks.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place; 0: none starts there
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := rank(piece[i:end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two is no longer what it was
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
            offer(before[i])
            offer(i)
        return [piece[i:e] for i, e in enumerate(end) if e]

    def encode_piece(self, text: str) -> bytes:
        """The ids of one pre-token as little-endian unsigned 32-bit integers."""
        piece = text.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(piece)) is not None:
            return whole.to_bytes(4, "little")
        parts = self.merge_few(piece) if len(piece) <= SHORT else self.merge_many(piece)
        return np.array([self.ranks[p] for p in parts], "<u4").tobytes()

    def encode_pieces(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.kept.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(self.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, joined."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, text: str, last: bool) -> np.ndarray:
        """Where pre-tokens of a chunk start, as far as what follows the chunk can't change them; the end too if the text ends there."""
        found = np.cumsum([0, *map(len, self.split(text))])
        if found[-1] != len(text):
            raise ValueError("the pattern must match every character")
        return found if last else found[:np.searchsorted(found, max(len(text) - LOOKAHEAD, 0), "right")]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _lists(ids: list[bytes]) -> pa.Array:
    at = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _result(kind: pa.DataType, keys: list, ids: list[bytes], decoded: list[bytes], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), _lists(ids), pa.array(decoded, pa.binary())], [name, "ids", "decoded"])


def _chunk_schema(docs: DataFrame, id_col: str) -> StructType:
    """``row`` names a document, as ids may repeat; chunks ``chunk`` to ``last`` are joined here; ``size`` is the document's."""
    names = [("row", LongType()), ("chunk", LongType()), ("last", LongType()), ("start", LongType()), ("size", LongType()), ("text", StringType())]
    return StructType([StructField("id", docs.schema[id_col].dataType), *(StructField(n, t) for n, t in names)])


def cut(texts: DataFrame, schema: StructType, chunk: int, overlap: int) -> DataFrame:
    """Chunks of every text; a task numbers its documents, so the result must be written before it is used."""
    step = chunk - overlap

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                for lo in range(0, max(len(text) - overlap, 1), step << 5):  # 32 chunks at a time
                    starts = range(lo, min(lo + (step << 5), max(len(text) - overlap, 1)), step)
                    places, n = [s // step for s in starts], len(starts)
                    cols = [pa.array([key.as_py()] * n, b.schema.field(0).type), pa.array([row] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(places, pa.int64()),
                            pa.array(list(starts), pa.int64()), pa.array([len(text)] * n, pa.int64()), pa.array([text[s:s + chunk] for s in starts], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())
                row += 1
    return texts.mapInArrow(run, schema)


def pretokenised(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Chunks with their boundaries: ``bounds`` from the chunk's start as 32-bit integers, and as places in the
    document those in the overlap with the chunk before (``head``) and with the next one (``tail``)."""
    step = chunk - overlap
    schema = StructType([*chunks.schema.fields, StructField("bounds", BinaryType()), StructField("head", ArrayType(LongType())), StructField("tail", ArrayType(LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            bounds, heads, tails = [], [], []
            for last, start, size, text in zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6))):
                found = e.boundaries(text, start + len(text) == size)
                bounds.append(found.astype("<u4").tobytes())
                heads.append(found[:np.searchsorted(found, overlap, "right")] + start)
                tails.append(found[np.searchsorted(found, (last + 1) * step - start):] + start)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bounds, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], schema.fieldNames())
    return chunks.mapInArrow(run, schema)


def neighbours(chunks: DataFrame) -> DataFrame:
    """(row, chunk, before, meet): for every chunk but a document's first, the one before and the first boundary that both have."""
    left = chunks.select("row", (F.col("last") + 1).alias("chunk"), F.col("chunk").alias("before"), "tail")
    return left.join(chunks.select("row", "chunk", "head"), ["row", "chunk"]).select("row", "chunk", "before", F.array_min(F.array_intersect("tail", "head")).alias("meet"))


def rejoined(chunks: DataFrame, pairs: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Chunks that met their neighbours, and those that did not, each with what follows it up to the next that did."""
    apart = pairs.filter("meet is null").select("row", "chunk").withColumn("apart", F.lit(True))
    order = Window.partitionBy("row").orderBy("chunk")
    some = chunks.select("row", "chunk").join(apart.select("row").distinct(), "row", "left_semi").join(apart, ["row", "chunk"], "left")
    heads = some.select("row", "chunk", F.max(F.when(F.col("apart").isNull(), F.col("chunk"))).over(order).alias("first"), "apart")
    follows = F.lead("apart").over(order)
    members = heads.select("row", "chunk", "first", (F.col("apart").isNotNull() | follows.isNotNull()).alias("open")).filter("open").drop("open")
    names = schema.fieldNames()
    kept = chunks.join(members, ["row", "chunk"], "left_anti")
    dealt = chunks.select(*names).join(members, ["row", "chunk"]).select(*names, "first").repartition("row", "first").sortWithinPartitions("row", "first", "chunk")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None

        def result() -> pa.RecordBatch:
            key, row, first, last, start, size, parts, _ = now
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, row, first, last, start, size, "".join(parts)), [kind, *[pa.int64()] * 5, pa.string()])], names)
        for b in batches:
            kind = b.schema.field(0).type
            for key, row, _, last, start, size, text, first in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or (now[1], now[2]) != (row, first):
                    if now is not None:
                        yield result()
                    now = [key, row, first, last, start, size, [text], start + len(text)]
                else:
                    now[6].append(text[now[7] - start:])
                    now[3], now[7] = last, start + len(text)
        if now is not None:
            yield result()
    return kept, dealt.mapInArrow(run, schema)


def stitched(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pre-tokenised chunks, each with the part of its document that is its own: from ``own`` up to ``until``."""
    schema = chunks.schema
    found = written(pretokenised(chunks.repartition("row", "chunk"), path, pattern, chunk, overlap), "pretokens")
    while True:
        pairs = written(neighbours(found), "neighbours")
        if pairs.filter("meet is null").isEmpty():
            break
        kept, again = rejoined(found, pairs, schema)
        found = written(kept.select(*found.columns).unionByName(pretokenised(again, path, pattern, chunk, overlap)), "pretokens")
    none = F.lit(None).cast("long")
    sides = pairs.select("row", "chunk", F.col("meet").alias("own"), none.alias("until")).unionByName(pairs.select("row", F.col("before").alias("chunk"), none.alias("own"), F.col("meet").alias("until")))
    limits = sides.groupBy("row", "chunk").agg(F.max("own").alias("own"), F.max("until").alias("until"))
    return (found.join(limits, ["row", "chunk"], "left")
            .select("id", "row", "chunk", "start", "text", "bounds", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("until", "size").alias("until")))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids, decoded) of every row: the ids of the whole text in order and the bytes that they decode to.

    A null or empty text has no ids and decodes to no bytes. Repeated rows and
    ids are each returned; an empty table gives an empty result. A text of at
    most ``chunk`` code points is one chunk and needs no stitching; longer ones
    spread over tasks. What a task holds of a document grows with its longest
    pre-token, and where its ids are put together, with the result's own row.
    """
    if not 2 * overlap <= chunk or overlap <= LOOKAHEAD:
        raise ValueError("a chunk must be at least twice the overlap, and that longer than the lookahead")
    texts = texts_and_ids(docs, id_col, text_col)
    result = with_id(docs, id_col, ("ids", ArrayType(IntegerType())), ("decoded", BinaryType()))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids = [e.encode(t) for t in texts[lo:hi]]
                yield _result(b.schema.field(0).type, b.column(0).slice(lo, hi - lo).to_pylist(), ids, [e.decode(x) for x in ids], id_col)

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            out = []
            for start, text, bounds, own, until in zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6, 7))):
                at = np.frombuffer(bounds, "<u4")
                at = at[np.searchsorted(at, own - start):np.searchsorted(at, until - start, "right")].tolist()
                out.append(e.encode_pieces([text[x:y] for x, y in zip(at, at[1:])]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["id", "row", "chunk", "ids"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        now = None

        def flush() -> pa.RecordBatch:
            ids = b"".join(now[2])
            return _result(kind, [now[1]], [ids], [e.decode(ids)], id_col)
        for b in batches:
            kind = b.schema.field(0).type
            for key, row, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
                if now is None or now[0] != row:
                    if now is not None:
                        yield flush()
                    now = (row, key, [])
                now[2].append(ids)
        if now is not None:
            yield flush()
    long = F.length("text") > chunk
    short = texts.filter(~long).mapInArrow(whole, result)
    schema = _chunk_schema(docs, id_col)
    chunks = written(cut(texts.filter(long), schema, chunk, overlap), "chunks")
    if chunks.isEmpty():
        return short
    owned = stitched(chunks, path, pattern, chunk, overlap)
    encoded = owned.mapInArrow(parts, StructType([*schema.fields[:3], StructField("ids", BinaryType())]))
    return short.unionByName(encoded.repartition("row").sortWithinPartitions("row", "chunk").mapInArrow(joined, result))
