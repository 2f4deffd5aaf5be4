"""Removal of long repeated byte strings by column-wise suffix sorting.

Every byte that is covered by a string of ``length`` bytes which also starts
anywhere else goes. Windows of that length that are equal have the same least
anchor (the anchor of smallest hash among the window's short grams) at the same
place, so runs of windows with one anchor are gathered by its hash:

1. Count anchors. A window whose anchor occurs once is not repeated. Equal runs that follow each other in a text, as in a
   stretch with a short period, are one row.
2. A run of windows that equals all other runs of its anchor is repeated as a
   whole; equal runs are told by hashes of anchor and content.
3. Where runs of an anchor differ, one string of each distinct content goes to
   the column-wise construction (``column_bwt``), aligned by the anchor, which
   finds the windows that occur in more than one of them. Strings of anchors with very many distinct ones
   are cut again by ever longer anchors, equal parts merged, and so spread over tasks; at the full length
   windows are counted, which gathers no group.
4. Repeated windows go back to their documents as intervals and are cut out.

Texts are shuffled compressed, and only to documents that hold candidates.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from .column_bwt import repeated_windows
from .common import map_batches, raw_texts, texts_and_ids, with_id, written

LENGTH, GRAM = 200, 64
#: Windows of a document that are anchored at a time; bounds memory for long texts.
CHUNK = 1 << 19
#: Bytes of strings that one construction sorts, and distinct strings of an anchor beyond which longer anchors cut
#: them: of four fifths, nine tenths and all of the length.
BATCH_BYTES, HOT_STRINGS = 4 << 20, 1 << 15

_ODD = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 21) - 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    return up, down


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every stretch of ``width``."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchored(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a text's runs of windows with one anchor, chunk by chunk: the anchor's hash, the first window, the number of
    windows, and how far behind the run's beginning the anchor stands."""
    up, down = _powers(CHUNK + length)
    for begin in range(0, len(text) - length + 1, CHUNK):
        part = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - begin), begin)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], dtype=np.uint64)])
        hashes = (total[gram:] - total[:-gram]) * down[:len(part) - gram + 1]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(factor)
        hashes ^= hashes >> np.uint64(32)
        # the place decides between equal hashes, so that it depends on the window alone
        place = (_least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        yield hashes[place[first]].view(np.int64), first + begin, np.diff(np.concatenate([first, [len(place)]])), place[first] - first


def _content(text: bytes, first: int, n: int, length: int) -> bytes:
    return text[first:first + n + length - 1]


def _merged(anchor: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, ...]:
    """A text's runs with equal ones that follow each other as one, and how many each stands for.

    A stretch with a short period gives a run for each of its periods; merged, it is one row however long it is.
    """
    same = (np.diff(anchor) == 0) & (np.diff(n) == 0) & (np.diff(at) == 0) & (np.diff(content) == 0) & (first[1:] == first[:-1] + n[:-1])
    heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
    return (*(x[heads] for x in (anchor, first, n, at, content)), np.diff(np.concatenate([heads, [len(first)]])))


def runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, key, anchor, first, n, at, content, turns) of all runs of windows; content is a hash.

    A row with ``turns`` above one stands for that many equal runs of n windows, one right after another.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            size = 0
            for i, text in enumerate(raw_texts(b.column(2))):
                for anchor, first, n, at in anchored(text, length, gram):
                    content = [xxhash.xxh3_64_intdigest(text[s:s + k + length - 1]) for s, k in zip(first.tolist(), n.tolist())]
                    found = _merged(anchor, first, n, at, np.array(content, np.uint64).view(np.int64))
                    for col, v in zip(cols, (np.full(len(found[0]), i), *found)):
                        col.append(v)
                    size += len(found[0])
                if size >= 1 << 16 or i + 1 == b.num_rows and size:
                    row, *rest = (np.concatenate(c) for c in cols)
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *(pa.array(x, pa.int64()) for x in rest)], names)
                    cols, size = [[] for _ in names[1:]], 0
    names = ["id", "key", "anchor", "first", "n", "at", "content", "turns"]
    return keyed.mapInArrow(run, with_id(keyed, "id", *((c, LongType()) for c in names[1:])))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])


def _packed(keyed: DataFrame) -> DataFrame:
    """(id, key, packed) with the text compressed, which halves what is shuffled and written."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packer.compress(t) for t in raw_texts(b.column(2))], pa.binary())],
                                          ["id", "key", "packed"])
    return map_batches(keyed, run, with_id(keyed, "id", ("key", LongType()), ("packed", BinaryType())))


def _strings(held: DataFrame, length: int) -> DataFrame:
    """(anchor, content, count, at, string) of the runs in the column ``wanted`` of ``held``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for packed, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = zstandard.decompress(packed)
                for w in wanted:
                    for col, v in zip(cols, (w["anchor"], w["content"], w["count"], w["at"], _content(text, w["first"], w["n"], length))):
                        col.append(v)
            kinds = (*[pa.int64()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "content", "count", "at", "string"])
    return held.filter("wanted is not null").select("packed", "wanted").mapInArrow(run, "anchor long, content long, count long, at long, string binary")


def _recut(strings: DataFrame, length: int, gram: int) -> DataFrame:
    """Strings of hot groups cut by longer anchors: (group, anchor, content, count, offset, at, n, digest, string).

    At the full length each window is a string of its own, told by its digest alone.
    """
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names]
        for anchor, content, count, offset, string in zip(*(c.to_pylist() for c in b.columns)):
            for found in anchored(string, length, gram):
                for g, s, k, at in zip(*(x.tolist() for x in found)):
                    part = _content(string, s, k, length)
                    row = (g, anchor, content, count, offset + s, at, k, xxhash.xxh3_128_digest(part), part if gram < length else b"")
                    for col, v in zip(cols, row):
                        col.append(v)
        kinds = (*[pa.int64()] * 7, pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
    names = ["group", "anchor", "content", "count", "offset", "at", "n", "digest", "string"]
    return map_batches(strings.select("anchor", "content", "count", "offset", "string"), run,
                       "group long, anchor long, content long, count long, offset long, at long, n long, digest binary, string binary")


def _repeated(strings: DataFrame, length: int, hot_strings: int) -> DataFrame:
    """(anchor, content, first, n): runs of windows that are repeated among ``strings``; no sorted group has more than ``hot_strings``.

    Strings of larger groups are cut by ever longer anchors. Parts that occur more than once are repeated as a whole, so one
    of each goes on. Windows of the full length that still are in a larger group are only counted.
    """
    sortable, found = [], []
    for gram in (length * 4 // 5, length * 9 // 10, length):
        hot = strings.groupBy("group").agg(F.count("*").alias("strings")).filter(F.col("strings") > hot_strings)
        hot = written(hot.select("group", F.lit(True).alias("hot")), "dedup-hot")
        marked = strings.join(hot, "group", "left")
        sortable.append(marked.filter("hot is null").drop("hot"))
        if hot.isEmpty():
            break
        cut = written(_recut(marked.filter("hot"), length, gram), "dedup-cut")
        one = F.first(F.struct("anchor", "content", "offset", "at", "string")).alias("one")
        # written, so that the join deals both sides afresh and can split a part that very many strings share
        distinct = written(cut.groupBy("group", "digest").agg(F.sum("count").alias("times"), one), "dedup-distinct")
        twice = distinct.filter("times > 1").select("group", "digest")
        found.append(cut.join(twice, ["group", "digest"]).select("anchor", "content", F.col("offset").alias("first"), "n"))
        strings = distinct.select("group", "one.anchor", "one.content", F.lit(1).cast("long").alias("count"), "one.offset", "one.at", "one.string")
    return reduce(DataFrame.unionByName, found, _sorted_windows(reduce(DataFrame.unionByName, sortable), length))


def _sorted_windows(strings: DataFrame, length: int) -> DataFrame:
    """(anchor, content, first, n): runs of windows that are repeated among the strings of their group."""
    def found(rows: list[tuple]) -> list[tuple]:
        # equal strings of a group are one string of the collection
        distinct: dict[tuple[int, bytes], list[tuple]] = {}
        for r in rows:
            distinct.setdefault((r[0], r[6]), []).append(r)
        out = []
        columns = [-same[0][5] for same in distinct.values()]
        for again, same in zip(repeated_windows([s for _, s in distinct], columns, length), distinct.values()):
            if len(same) > 1 or same[0][3] > 1:
                again = np.ones(len(again), bool)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                out += [(anchor, content, offset + a, b - a) for _, anchor, content, _, offset, _, _ in same]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def result() -> Iterator[pa.RecordBatch]:
            if rows := found(held):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["anchor", "content", "first", "n"])
            held.clear()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BATCH_BYTES and held[-1][0] != row[0]:
                    yield from result()
                    size = 0
                held.append(row)
                size += len(row[6])
        yield from result()
    dealt = strings.repartition("group").sortWithinPartitions("group", "string")
    return dealt.select("group", "anchor", "content", "count", "offset", "at", "string").mapInArrow(run, "anchor long, content long, first long, n long")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
            hot_strings: int = HOT_STRINGS) -> DataFrame:
    """(id, key, n_removed, n_spans, kept_sha256, kept) of each distinct document that loses bytes.

    ``key`` is a hash of id and text; ``kept`` holds the remaining bytes, compressed.
    """
    rows = texts_and_ids(docs, id_col, text_col)
    keyed = rows.select("id", _key().alias("key"), "text").filter(F.octet_length("text") >= length)
    found = runs(keyed, length, gram)
    anchors = (found.groupBy("anchor").agg(F.sum("turns").alias("times"), (F.min("content") != F.max("content")).alias("mixed"))
               .filter("times > 1").select("anchor", "mixed"))
    # written, so that the join deals both sides afresh and can split an anchor that a third of all runs share
    known = written(found.join(written(anchors, "dedup-anchors"), "anchor"), "dedup-runs")
    mixed = known.filter("mixed")
    # one place of each distinct content stands for all
    place = F.struct("id", "key", "first", "n", F.col("at").alias("behind"))
    contents = (mixed.groupBy("anchor", "content").agg(F.sum("turns").alias("count"), F.min(place).alias("at"))
                .select("anchor", "content", "count", "at.*"))
    contents = contents.withColumnRenamed("behind", "at")
    wanted = contents.groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "content", "count", "first", "n", "at")).alias("wanted"))
    holders = known.groupBy("id", "key").agg(F.lit(1).alias("one"))
    holders = holders.join(wanted, _same(holders, wanted), "left").select(holders["id"], holders["key"], "wanted")
    texts = _packed(keyed)
    held = written(texts.join(holders, _same(texts, holders)).select(texts["id"], texts["key"], "packed", "wanted")
                   .dropDuplicates(["id", "key"]), "dedup-texts")
    strings = written(_strings(held, length), "dedup-strings")
    grouped = strings.select(F.col("anchor").alias("group"), "anchor", "content", "count", F.lit(0).cast("long").alias("offset"), "at", "string")
    again = _repeated(grouped, length, hot_strings)
    windows = mixed.filter("turns = 1").select("id", "key", "anchor", "content", F.col("first").alias("base")).join(again, ["anchor", "content"])
    # runs that stand for several repeat each other as a whole
    intervals = (known.filter("not mixed or turns > 1").select("id", "key", "first", (F.col("n") * F.col("turns")).alias("n"))
                 .unionByName(windows.select("id", "key", (F.col("base") + F.col("first")).alias("first"), "n")))
    spans = intervals.groupBy("id", "key").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return _cut(held.select("id", "key", "packed").join(spans, _same(held, spans)).select(held["id"], held["key"], "packed", "spans"), length)


def _key() -> Column:
    return F.xxhash64("id", "text")


def _cut(held: DataFrame, length: int) -> DataFrame:
    """Cut the windows in ``spans`` out of the packed texts."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=3)
        cols: list[list] = [[], [], [], []]
        for packed, spans in zip(b.column(2).to_pylist(), b.column(3)):
            text = zstandard.decompress(packed)
            at = spans.values
            first, n = at.field("first").to_numpy(), at.field("n").to_numpy()
            change = np.zeros(len(text) + 1, np.int32)
            np.add.at(change, first, 1)
            np.add.at(change, first + n + length - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            starts = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
            for col, v in zip(cols, (int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), packer.compress(kept))):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)
    names = ["id", "key", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = with_id(held, "id", ("key", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType()), ("kept", BinaryType()))
    return map_batches(held, run, schema)


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
            hot_strings: int = HOT_STRINGS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    A null text counts as empty; texts shorter than ``length`` lose nothing.
    Repeated rows and ids are judged one by one, and each other's bytes repeat.
    An empty table gives an empty result.
    """
    rows = texts_and_ids(docs, id_col, text_col)
    base = rows.select("id", _key().alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    cut = repeats(docs, length, gram, id_col, text_col, hot_strings).drop("kept")
    return (base.join(cut, _same(base, cut), "left")
            .select(base["id"].alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the remaining text in ``text_col``.

    Bytes of a character that lost some of them go as well, so the text is
    valid. Rows that lose nothing keep their text, null included. Other columns
    are carried as one struct, whatever their names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(row, F.col(f"`{id_col}`").alias("id"), text.alias("text")).select("row", "id", _key().alias("key"))
    cut = repeats(docs, length, gram, id_col, text_col).select("id", "key", "kept")

    @F.pandas_udf("string")
    def unpacked(kept):
        return kept.map(lambda x: None if x is None else zstandard.decompress(x).decode("utf-8", "ignore"))
    joined = rows.join(cut, _same(rows, cut), "left").select("row", unpacked("kept").alias("left"))
    return joined.select(*(F.coalesce("left", F.col("row").getField(c)).alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                           for c in docs.columns))
