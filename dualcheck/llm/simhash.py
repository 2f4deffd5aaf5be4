"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint takes the majority of the XXH64 hashes of its word
shingles, bit by bit. Distinct fingerprints that differ in at most ``radius``
bits are linked; documents in one connected component are near-duplicates.

The comparison is exact. Two fingerprints within the radius agree on at least
two of ``radius + 2`` bit blocks, so they meet under one of the block pairs.
What meets under a key is cut into tiles by population count. Pairs of tiles
whose population counts differ by more than the radius are skipped before
anything is shuffled for them; numpy compares the others by exclusive-or and bit
counts. A key with more rows than a tile is dealt into tile pairs over many
tasks. A tile pair returns a spanning forest of its links, never all pairs, and
components are found by rounds of star contraction over tables in the shared
folder.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import MARK, identity, map_batches, raw_texts, texts_and_ids, with_id, written

SEED = 42
TILE = 2048

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 majority bits of the shingle hashes of a text, as a signed integer."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as long) of every row; a null text counts as empty, a text without words gets zero."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t, words) for t in raw_texts(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], [id_col, "fingerprint"])
    return map_batches(texts_and_ids(docs, id_col, text_col), run, with_id(docs, id_col, ("fingerprint", LongType())))


def _close(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, strip by strip; both sides sorted by population count."""
    px, py = np.bitwise_count(x), np.bitwise_count(y)
    for at in range(0, len(x), 256):
        end = min(at + 256, len(x))
        lo = at if same else np.searchsorted(py, max(0, int(px[at]) - radius))
        hi = np.searchsorted(py, int(px[end - 1]) + radius, "right")
        if lo < hi:
            i, j = np.nonzero(np.bitwise_count(x[at:end, None] ^ y[None, lo:hi]) <= radius)
            i, j = i + at, j + lo
            yield (i[i < j], j[i < j]) if same else (i, j)


def _forest(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles, or within one."""
    nodes = x if same else np.concatenate([x, y])
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    out = []
    for i, j in _close(x, y, radius, same):
        for a, b in zip(i.tolist(), (j if same else j + len(x)).tolist()):
            if (ra := find(a)) != (rb := find(b)):
                root[rb] = ra
                out.append((a, b))
    values = nodes.view(np.int64).tolist()
    return [(values[a], values[b]) for a, b in out]


def tile_pairs(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(t, key, first, second, right, fingerprint): the rows of every pair of tiles that is compared.

    Tiles of a key number its population counts upward: neighbouring counts share a tile until it is full, and a count
    with more rows than a tile is dealt over several by hash. A row goes to the tiles that hold counts within the radius of its own.
    """
    count = radius + 2
    edges = [64 * i // count for i in range(count + 1)]
    masks = [sum(1 << bit for k in pair for bit in range(edges[k], edges[k + 1])) for pair in combinations(range(count), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    fp = F.col("fingerprint")
    keys = F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), fp.bitwiseAND(F.lit(m)).alias("key"))
                     for i, m in enumerate(signed)))
    keyed = prints.select(fp, F.bit_count(fp).alias("pop"), F.explode(keys).alias("k")).select("k.t", "k.key", "pop", "fingerprint")
    # a key has at most 65 population counts, so these windows stay small however many rows share it
    whole = Window.partitionBy("t", "key")
    upward, near = whole.orderBy("pop"), whole.orderBy("pop").rangeBetween(-radius, radius)
    band = Window.partitionBy("t", "key", "band")
    sizes = (keyed.groupBy("t", "key", "pop").agg(F.count("*").alias("n"))
             .withColumn("all", F.sum("n").over(whole)).filter(F.col("all") > 1)
             .withColumn("band", F.floor((F.sum("n").over(upward) - F.col("n")) / tile))
             .withColumn("parts", F.ceil(F.sum("n").over(band) / tile).cast("int"))
             .withColumn("opens", F.when(F.row_number().over(band.orderBy("pop")) == 1, F.col("parts")).otherwise(0))
             .withColumn("start", (F.sum("opens").over(upward) - F.col("parts")).cast("int"))
             .withColumn("from", F.min("start").over(near)).withColumn("to", F.max(F.col("start") + F.col("parts") - 1).over(near)))
    # written, so that the join deals both sides afresh and can split a key that a third of all rows share
    sizes = written(sizes.select("t", "key", "pop", "start", "parts", "from", "to"), "key-sizes")
    own = F.col("start") + F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    # a tile of a large key meets others: as the first of a pair with itself and later ones, else as the second
    return (keyed.join(sizes, ["t", "key", "pop"]).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence("from", "to")))
            .select("t", "key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
                    (F.col("own") > F.col("other")).alias("right"), "fingerprint"))


def links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column ``fingerprint``) within the radius."""
    tiles = tile_pairs(prints, radius, tile)
    group = ["t", "key", "first", "second"]
    dealt = tiles.repartition(*(F.col(c) for c in group)).sortWithinPartitions(*group)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def run(cols: list[np.ndarray]) -> list[tuple[int, int]]:
            t, key, first, second, right, f = cols
            new = (np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(first) != 0) | (np.diff(second) != 0)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(t)]])
            out = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo > 1:
                    values, side = f[lo:hi].view(np.uint64), right[lo:hi]
                    order = np.argsort(np.bitwise_count(values), kind="stable")
                    values, side = values[order], side[order]
                    same = first[lo] == second[lo]
                    out += _forest(values, values, radius, True) if same else _forest(values[~side], values[side], radius, False)
            return out
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = [np.concatenate([k, c]) for k, c in zip(kept, cols)] if kept else cols
            tail = np.ones(len(cols[0]), bool)
            for c in cols[:4]:
                tail &= c == c[-1]
            cut = int(np.flatnonzero(~tail)[-1]) + 1 if not tail.all() else 0
            kept = [c[cut:] for c in cols]
            if cut and (found := run([c[:cut] for c in cols])):
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], ["a", "b"])
        if kept and (found := run(kept)):
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], ["a", "b"])
    return dealt.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Rounds of large-star and small-star contraction, each written to the shared
    folder, until the links no longer change. Every link then points from a
    node to its root.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while (state := mark(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fingerprint, root): the smallest fingerprint of the component of each one in ``prints``."""
    distinct = prints.select("fingerprint").distinct()
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fingerprint")
    return distinct.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, fingerprint as long, component_id) of every row of ``docs``.

    component_id is the smallest id reachable over links of at most ``radius``
    differing bits; equal fingerprints are one node. A null or empty text has
    fingerprint zero and links like any other. Repeated rows and ids are all
    returned. A row with a null id links others through its fingerprint; a
    component in which all ids are null has a null component_id. An empty table
    gives an empty result.
    """
    prints = written(fingerprints(docs, words, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    least = prints.groupBy("fingerprint").agg(F.min("id").alias("least"))
    rooted = least.join(classes(prints, radius), "fingerprint")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(found, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, all columns: that with the smallest id (null ids last, then by hash).

    Rows that repeat id and text are one row of the result.
    """
    # a row is known by its id and a hash of its text; both go through as the id of its fingerprint
    marked = docs.withColumn(MARK, identity(docs, id_col, text_col))
    prints = written(fingerprints(marked, words, MARK, text_col), "fingerprints")
    rank = F.struct(F.col(MARK)["id"].isNull().alias("last"), F.col(MARK).alias("row"))
    least = prints.groupBy("fingerprint").agg(F.min(rank).alias("least")).join(classes(prints, radius), "fingerprint")
    keep = least.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least")["row"].alias(MARK))
    return marked.join(keep, MARK, "left_semi").dropDuplicates([MARK]).select(*(F.col(f"`{c}`") for c in docs.columns))
