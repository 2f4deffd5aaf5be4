"""Exact top-k search by a bit-sliced index.

Components are quantised to integers. A block of candidates holds, for each
attribute and bit, a bitmap over its rows: the bit slices. The score of all rows
of a block against a query is then a sum of slices, each weighted by the bits of
the query's component (a negative one takes the complement). Full adders on
bitmaps sum the slices, many at a time, into slices of the score. The selection
goes from the most significant slice of the score downward, keeping the rows
that are in for sure and those still undecided; the rows left undecided at the
end are the boundary: they have equal scores, and the smallest ids win.

Queries are dealt in small blocks to all blocks of candidates; a task holds one
block of candidates and lets its queries stream by.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 64
#: Rows of a block of candidates, queries of a block, and blocks of queries that share a copy of a block of candidates.
BLOCK, QUERY_BLOCK, SHARE = 32_768, 64, 8


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, q): floor(scale * x) of each component; rows without a vector, or with null or non-finite components, are left out."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.filter(v.isNotNull()).filter(~odd)
            .select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q")))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    lengths = np.asarray(lists.value_lengths())
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def sliced(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each attribute's least value, and bitmaps (attribute, bit, word) of what its rows have above it."""
    low = q.min(0)
    above = (q - low).astype(np.uint64)
    bits = max(1, int(above.max()).bit_length()) if above.size else 1
    words = -(-len(q) // 64)
    padded = np.zeros((words * 64, q.shape[1]), np.uint64)
    padded[:len(q)] = above
    out = np.empty((q.shape[1], bits, words), np.uint64)
    for b in range(bits):
        packed = np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b] = np.ascontiguousarray(packed).view("<u8")
    return low, out


def summed(levels: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Bitmaps of the bits of a sum, least significant first; levels[i] holds the bitmaps of weight 2**i, one a row."""
    out, i = [], 0
    words = next(iter(levels.values())).shape[1] if levels else 0
    while levels:
        x = levels.pop(i, np.zeros((0, words), np.uint64))
        carries = []
        while len(x) >= 3:
            n = len(x) // 3
            a, b, c = x[:n], x[n:2 * n], x[2 * n:3 * n]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            x = np.concatenate([ab ^ c, x[3 * n:]])
        if len(x) == 2:
            carries.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        out.append(x[0] if len(x) else np.zeros(words, np.uint64))
        if carries:
            levels[i + 1] = np.concatenate([*([levels[i + 1]] if i + 1 in levels else []), *carries])
        i += 1
    return out


def scores(query: np.ndarray, low: np.ndarray, slices: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """A constant and the slices of what every row's score has above it."""
    width = min(len(query), len(low))
    weight, bits = query[:width], slices.shape[1]
    top = (1 << bits) - 1
    constant = int((weight * low[:width]).sum()) + int(weight[weight < 0].sum()) * top
    levels: dict[int, list[np.ndarray]] = {}
    size, negative = np.abs(weight), weight < 0
    for k in range(int(size.max()).bit_length() if width else 0):
        has = size >> k & 1 == 1
        plus, minus = np.flatnonzero(has & ~negative), np.flatnonzero(has & negative)
        for b in range(bits):
            levels.setdefault(k + b, []).append(np.concatenate([slices[plus, b], ~slices[minus, b]]))
    return constant, summed({i: np.concatenate(x) for i, x in levels.items()})


def top_rows(score: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows that are among the k best for sure, and of those that tie at the boundary."""
    sure, open_ = np.zeros_like(allowed), allowed
    count = lambda x: int(np.bitwise_count(x).sum())
    if count(allowed) <= k:
        return allowed, sure
    for s in reversed(score):
        both = sure | open_ & s
        n = count(both)
        if n > k:
            open_ = open_ & s
        else:
            sure, open_ = both, open_ & ~s
            if n == k:
                return sure, np.zeros_like(sure)
    return sure, open_


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.astype("<u8").view(np.uint8), bitorder="little"))


def best(query: np.ndarray, own: int, ids: np.ndarray, low: np.ndarray, slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a block, other than the query's own, ties to smaller ids."""
    allowed = np.zeros(slices.shape[2] * 64, np.uint8)
    allowed[:len(ids)] = ids != own
    allowed = np.packbits(allowed, bitorder="little").view("<u8").astype(np.uint64)
    constant, score = scores(query, low, slices)
    sure, tied = (_rows(x) for x in top_rows(score, allowed, k))
    if len(sure) < k and len(tied):
        tied = tied[np.argsort(ids[tied], kind="stable")[:k - len(sure)]]
        sure = np.concatenate([sure, tied])
    value = np.full(len(sure), constant, np.int64)
    for i, s in enumerate(score):
        value += (s[sure >> 6] >> (sure & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << i
    return ids[sure], value


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by integer inner product, ties to smaller ids.

    A query's own row is the one with its id. Rows with a null id are neither
    queries nor candidates; so are vectors that are null or hold null or
    non-finite components. Shorter vectors count as filled up with zeros.
    Repeated rows are candidates each for itself; a query repeated with the same
    vector is answered once. Quantised components and scores must fit 62 bits.
    Empty tables give an empty result.
    """
    rows = quantised(vectors, id_col, vector_col, scale).filter("id is not null")
    asked = quantised(queries, id_col, vector_col, scale).filter("id is not null").distinct()
    rows = written(rows, "vectors")
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks, query_blocks = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // QUERY_BLOCK))
    shares = -(-query_blocks // SHARE)

    def index(t: pa.Table) -> pa.Table:
        low, slices = sliced(_matrix(t.column("q").combine_chunks()))
        return pa.table({"block": t.column("block")[:1].cast(pa.int32()), "ids": [t.column("id").to_numpy().astype("<i8").tobytes()], "low": [low.tobytes()],
                         "slices": [slices.tobytes()], "bits": pa.array([slices.shape[1]], pa.int32())})

    def gathered(t: pa.Table) -> pa.Table:
        q = _matrix(t.column("q").combine_chunks())
        ids = np.stack([t.column("query").to_numpy(), t.column("id").to_numpy()]).astype("<i8")
        return pa.table({"query_block": t.column("query_block")[:1].cast(pa.int32()), "ids": [ids.tobytes()], "low": [q.tobytes()]})
    # by hash: numbers start anew in each partition, so short partitions would fill the first blocks alone
    row = F.xxhash64(F.monotonically_increasing_id())
    built = (rows.withColumn("block", F.pmod(row, F.lit(blocks)).cast("int")).groupBy("block")
             .applyInArrow(index, "block int, ids binary, low binary, slices binary, bits int"))
    built = built.select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(-1).alias("query_block"), "ids", "low", "slices", "bits")
    dealt = (asked.withColumn("query_block", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).groupBy("query_block")
             .applyInArrow(gathered, "query_block int, ids binary, low binary"))
    dealt = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod("query_block", F.lit(shares)).cast("int").alias("share"),
                         "query_block", "ids", "low", F.lit(None).cast("binary").alias("slices"), F.lit(0).alias("bits"))
    together = built.unionByName(dealt).repartition("block", "share").sortWithinPartitions("block", "share", "query_block")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for query_block, ids, low, slices, bits in zip(*(b.column(c).to_pylist() for c in ("query_block", "ids", "low", "slices", "bits"))):
                if query_block < 0:
                    own, least = np.frombuffer(ids, "<i8"), np.frombuffer(low, np.int64)
                    held = own, least, np.frombuffer(slices, np.uint64).reshape(len(least), bits, -(-len(own) // 64))
                    continue
                numbers, own = np.frombuffer(ids, "<i8").reshape(2, -1)
                asked = np.frombuffer(low, np.int64).reshape(len(own), -1)
                found = [best(q, int(o), *held, k) for q, o in zip(asked, own)]
                sizes = [len(x) for x, _ in found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, sizes)), pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([x for x, _ in found])),
                                                      pa.array(np.concatenate([x for _, x in found]))], ["query", "query_id", "vec_id", "score"])
    found = together.mapInArrow(search, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
