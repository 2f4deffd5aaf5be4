"""Phrases whose words occur together far more often than apart.

Texts are read once: each task numbers the words of its documents, writes them
as numbers in shards of whole documents, and keeps each shard's words with their
counts. Words of the corpus that are frequent enough to stand in a candidate get
a number of their own; a join turns the numbers of a shard into those. All
n-grams of such words are then counted in counting quotient filters
(``quotient_filter``), one for each task, and cut by ranges of the permuted key;
filters of one range are merged. A range holds about as many n-grams whatever
the words are, so neither a language nor a frequent phrase weighs on one task.
Read back from the filters, candidates are scored by joins.
"""
from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.corpus import numbered
from .common import raw_texts, written
from .quotient_filter import Filter, Keys

#: What ends a piece, as one byte; letters A-Z in lower case; a tab as a blank.
TABLE = bytes(ord(".") if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The language of documents without one.
NO_LANG = "und"
#: Words after which a shard ends, at the end of a document.
SHARD_WORDS = 1 << 19
#: Bytes of text whose words are in memory at a time.
SLICE = 1 << 20
#: N-grams that a task collects before it sorts them, and counters that it keeps before it writes them.
PENDING, KEPT = 1 << 20, 1 << 22
#: N-grams that a range of keys holds, on average.
SEGMENT = 1 << 20
#: Parts of a language's phrases that are ranked each by itself first.
PARTS = 32


class _Numbers(dict):
    """Numbers of the words of a language, in a list that languages share; what ends a piece has 0."""

    def __init__(self, lang: str, known: list[tuple[str, bytes]]):
        super().__init__({b".": 0})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        self.known.append((self.lang, word))
        self[word] = len(self.known)
        return len(self.known)


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and, as ".", what ends its pieces, in slices."""
    marked = text.translate(TABLE).replace(b".", b" . ")
    lo = 0
    while lo < len(marked):
        hi = len(marked)
        if lo + SLICE < hi:
            cut = marked.rfind(b" ", lo + 1, lo + SLICE)
            cut = cut if cut >= 0 else marked.find(b" ", lo + SLICE)
            hi = cut if cut >= 0 else hi
        yield marked[lo:hi].split()
        lo = hi


def shards(docs: DataFrame, text_col: str, lang_col: str, shard_words: int) -> DataFrame:
    """Texts as numbers of words; a task names its shards, so the result must be written before it is used.

    ``codes`` has the numbers of a shard's words, 0 where a piece or a document
    ends, as integers of ``width`` bytes, two if that many words are enough;
    number k + 1 is place k of langs, words and counts.
    """
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        codes, known, by_lang = array("I"), [], {}

        def flush() -> pa.RecordBatch:
            found = np.frombuffer(codes, np.uint32)
            counts = np.bincount(found, minlength=len(known) + 1)[1:]
            width = 2 if len(known) < 1 << 16 else 4
            cols = [[shard], [width], [found.astype(f"<u{width}").tobytes()], [[x for x, _ in known]], [[w for _, w in known]], [counts]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            cols = [pa.array(c, k) for c, k in zip(cols, kinds)]
            cols[4] = cols[4].cast(pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays(cols, ["shard", "width", "codes", "langs", "words", "counts"])
        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), raw_texts(b.column(0))):
                if lang not in by_lang:
                    by_lang[lang] = _Numbers(lang, known)
                number = by_lang[lang].__getitem__
                for some in words(text):
                    codes.extend(map(number, some))
                codes.append(0)
                if len(codes) >= shard_words:
                    yield flush()
                    shard += 1
                    codes, known, by_lang = array("I"), [], {}
        if len(codes):
            yield flush()
    return texts.mapInArrow(run, "shard long, width int, codes binary, langs array<string>, words array<string>, counts array<long>")


def _filters(coded: DataFrame, keys: tuple[Keys, Keys], segment_bits: int) -> DataFrame:
    """(n, segment, filter): the n-grams of two and three frequent words, counted in each task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[list[tuple]] = [[], []]
        held: list[list[Filter]] = [[], []]

        def sort(i: int) -> None:
            left, right = (np.concatenate(x) for x in zip(*pending[i]))
            held[i] = [Filter.merged(keys[i], [*held[i], Filter.of(keys[i], left, right)])]
            pending[i].clear()

        def write(i: int) -> Iterator[pa.RecordBatch]:
            for f in held[i]:
                found = f.segments(min(segment_bits, keys[i].widths[0]))
                for lo in range(0, len(found), 64):
                    some = found[lo:lo + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i].n] * len(some), pa.int32()), pa.array([s for s, _ in some], pa.int64()),
                                                      pa.array([x.to_bytes(min(segment_bits, keys[i].widths[0])) for _, x in some], pa.binary())], ["n", "segment", "filter"])
            held[i] = []
        for b in batches:
            for width, codes, own in zip(b.column(0), b.column(1), b.column(2)):
                found = np.frombuffer(codes.as_py(), f"<u{width.as_py()}")
                place, gid = (own.values.field(k).to_numpy() for k in range(2))
                table = np.zeros(int(found.max()) + 1, np.uint64)
                table[place] = gid
                ids = table[found]
                for i, k in enumerate(keys):
                    at = np.flatnonzero(np.logical_and.reduce([ids[j:len(ids) - k.n + 1 + j] > 0 for j in range(k.n)]))
                    if len(at):
                        pending[i].append(k.permuted([ids[at + j] for j in range(k.n)]))
                    if sum(len(x) for x, _ in pending[i]) >= PENDING:
                        sort(i)
                        if len(held[i][0]) >= KEPT:
                            yield from write(i)
        for i in range(2):
            if pending[i]:
                sort(i)
            yield from write(i)
    return coded.mapInArrow(run, "n int, segment long, filter binary")


def _counted(filters: DataFrame, keys: tuple[Keys, Keys], segment_bits: int, least: int) -> DataFrame:
    """(n, g1, g2, g3, a): the n-grams that occur ``least`` times, read back from the merged filters of each range."""
    dealt = filters.repartition("n", "segment").sortWithinPartitions("n", "segment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def result() -> pa.RecordBatch:
            f = Filter.merged(now[0], held)
            often = f.count >= least
            ids = [x.astype(np.int64) for x in f.keys.inverted(f.left[often], f.right[often])]
            ids += [np.zeros(len(ids[0]), np.int64)] * (3 - len(ids))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids[0]), f.keys.n, np.int32)), *map(pa.array, ids), pa.array(f.count[often])], ["n", "g1", "g2", "g3", "a"])
        for b in batches:
            for n, segment, data in zip(*(c.to_pylist() for c in b.columns)):
                k = keys[n - 2]
                if now != (k, segment):
                    if now is not None:
                        yield result()
                    now, held = (k, segment), []
                held.append(Filter.from_bytes(k, data, segment, min(segment_bits, k.widths[0])))
                if sum(map(len, held)) >= 4 * PENDING:
                    held = [Filter.merged(k, held)]
        if now is not None:
            yield result()
    return dealt.mapInArrow(run, "n int, g1 long, g2 long, g3 long, a long")


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to 38 digits."""
    return F.expr(f"(cast(1000000 as decimal(38,0)) * cast({a} as decimal(38,0)) * cast({a} as decimal(38,0))) div (cast({left} as decimal(38,0)) * cast({right} as decimal(38,0)))").cast("long")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50, text_col: str = "text", lang_col: str = "lang",
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Phrases have two or three words of one piece; pieces end at ``.,;:!?`` and at
    line ends, words at blanks and tabs. ``a`` is how often a phrase occurs; it
    must be ``least`` at the least. ``l`` and ``r`` are the occurrences of the two
    parts at its worst cut and ``n`` all words of the language. A phrase goes
    whose longer candidate has ``covered`` per cent of its occurrences. A null
    text counts as empty, a null language as "und"; repeated rows count each
    time. A language whose phrases are all rare has no row; an empty table gives
    an empty result. Ties go by ``a``, then by the phrase's bytes.
    """
    held = written(shards(docs, text_col, lang_col, shard_words), "shards")
    each = held.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "w")).select(
        "shard", (F.col("place") + 1).alias("place"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = held.select(F.explode(F.arrays_zip("langs", "counts")).alias("w")).groupBy(F.col("w.langs").alias("lang")).agg(F.sum("w.counts").alias("n"))
    totals = written(totals, "words-of-languages")
    frequent = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    frequent = written(numbered(written(frequent, "frequent-words"), "gid").withColumn("gid", F.col("gid") + 1), "numbered-words")

    size, every = frequent.count(), totals.agg(F.sum("n")).first()[0] or 0
    bits = max(size.bit_length(), 1)
    if bits > 32:
        raise ValueError("more than 2 ** 32 frequent words")
    segment_bits = max(2 * every // SEGMENT, 1).bit_length() - 1
    keys = Keys(2, bits), Keys(3, bits)
    known = (each.select("shard", "place", "lang", "word").join(frequent.select("lang", "word", "gid"), ["lang", "word"])
             .groupBy("shard").agg(F.collect_list(F.struct("place", "gid")).alias("own")))
    coded = held.select("shard", "width", "codes").join(known, "shard").select("width", "codes", "own")
    grams = written(_counted(_filters(coded, keys, segment_bits), keys, segment_bits, least), "frequent-phrases")

    word = lambda k: frequent.select(F.col("gid").alias(f"g{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))
    twos = written(grams.filter("n = 2").select("g1", "g2", "a").join(word(1), "g1").join(word(2), "g2"), "phrases-of-two")
    threes = grams.filter("n = 3").select("g1", "g2", "g3", "a")
    longer = (threes.select("g1", "g2", "a").unionAll(threes.select("g2", "g3", "a")).groupBy("g1", "g2").agg(F.max("a").alias("most")))
    two = (twos.join(longer, ["g1", "g2"], "left").filter(F.col("most").isNull() | (_wide("most") * 100 < _wide("a") * covered))
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score")))
    front = twos.select("lang", "g1", "g2", "w1", "w2", "f1", F.col("a").alias("f12"))
    back = twos.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    cuts = threes.join(front, ["g1", "g2"]).join(back, ["g2", "g3"]).select("*", _score("a", "f1", "f23").alias("s1"), _score("a", "f12", "f3").alias("s2"))
    late = F.col("s2") < F.col("s1")
    three = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"),
                        F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))
    best = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    # first within parts of a language, so that its last ranking reads PARTS * top rows at most
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
    first = two.unionByName(three).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
