"""Personal data by bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers in
each text. They are the seeds. Whatever else looks like an identifier (a token
with several digits) is an instance without a score. The words around seeds and
instances give lexical patterns; patterns and instances form a graph over the
whole corpus. Rounds of scoring follow: a pattern's confidence is the share of
its instances that are known, damped for few instances, and an instance's score
is the noisy-or of its patterns. Patterns of high confidence with enough seeds
then add the occurrences of unseen identifiers as spans of kind ``ident``.

Only hashes of patterns and instances leave the texts, and equal pairs are
merged before they are shuffled.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import map_batches, texts_and_ids, written

KINDS = ("email", "ip", "card", "phone")
IDENT = "ident"

# The patterns that define the base kinds. The possessive forms
# find the same matches without trying every start inside one run of digits.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile("[0-9]")
#: What may be an identifier: a token with digits, without the marks around it.
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?([A-Za-z0-9](?:[^\x20\x09-\x0D]*[A-Za-z0-9])?)")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = frozenset(" \t\n\v\f\r")
MIN_DIGITS = 5


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the base kinds, leftmost and non-overlapping in each."""
    found = [(s, 0, e, "email") for s, e in _emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text)
                  if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end(), "card"))
        if "+" in text:
            found += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text)
                      if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _hashed(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def words_before(text: str, start: int, low: int) -> list[str]:
    """The last two words before a place, however far back. What touches the place is a word of its own as far back
    as ``low``, where another span ends, so that spans without blanks between them aren't read again and again."""
    out: list[str] = []
    at = start
    while len(out) < 2:
        end = at
        while end and text[end - 1] in BLANK:
            end -= 1
        floor = low if end == start else 0
        at = end
        while at > floor and text[at - 1] not in BLANK:
            at -= 1
        if at < end:
            out.insert(0, text[at:end])
        if at == end or at and at == floor:
            break
    return out


def word_after(text: str, end: int, high: int) -> str:
    """The first word after a place, however far on; one that touches the place ends at ``high``, where another span starts."""
    at = end
    while at < len(text) and text[at] in BLANK:
        at += 1
    ceiling = high if at == end else len(text)
    stop = at
    while stop < ceiling and text[stop] not in BLANK:
        stop += 1
    return text[at:stop]


def _patterns(before: list[str], after: str) -> list[int]:
    """Hashes of the lexical patterns around a span: two words before it, one before it, one on each side."""
    clean = lambda w: w.lower().strip(".,;:!?\"'()[]")
    before, after = [clean(w) for w in before], clean(after)
    keys = []
    if before and before[-1]:
        keys.append("L1 " + before[-1])
        if len(before) == 2:
            keys.append("L2 " + " ".join(before))
        if after:
            keys.append(f"LR {before[-1]} _ {after}")
    return [_hashed(k) for k in keys if any(c.isalpha() for c in k[3:])]


def _digit_tokens(text: str):
    """Tokens with MIN_DIGITS digits or more, stripped of the marks around them."""
    last = 0
    for d in DIGIT.finditer(text):
        if d.start() < last:
            continue
        m = WORD.match(text, d.start())
        start = d.start()
        while start > last and text[start - 1] not in BLANK:
            start -= 1
        end = last = m.end()
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if sum("0" <= c <= "9" for c in text[start:end]) >= MIN_DIGITS:
            yield start, end


def occurrences(text: str) -> list[tuple[int, int, int, str, int, bool, list[int]]]:
    """(start, rank, end, kind, instance, seed, patterns) of seeds and of other identifiers."""
    found = [(s, r, e, k, True) for s, r, e, k in sorted(base_spans(text))]
    cover = [(s, e) for s, _, e, _, _ in found]
    at = 0
    for s, e in _digit_tokens(text):
        while at < len(cover) and cover[at][1] <= s:
            at += 1
        if not any(a < e and s < b for a, b in cover[at:at + len(KINDS)]):
            found.append((s, len(KINDS), e, IDENT, False))
    starts, ends = [0, *sorted(x[0] for x in found), len(text)], [0, *sorted(x[2] for x in found)]
    out = []
    for s, r, e, k, seed in found:
        low, high = ends[bisect_right(ends, s) - 1], starts[bisect_left(starts, e)]
        out.append((s, r, e, k, _hashed(text[s:e].lower()), seed, _patterns(words_before(text, s, low), word_after(text, e, high))))
    return out


_NAMES = ("start", "rank", "end", "kind", "instance", "seed", "patterns")
_SPAN = StructType([StructField("start", LongType()), StructField("rank", LongType()), StructField("end", LongType()),
                    StructField("kind", StringType()), StructField("instance", LongType()), StructField("seed", BooleanType()),
                    StructField("patterns", ArrayType(LongType()))])
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int64()), ("end", pa.int64()), ("kind", pa.string()),
                                   ("instance", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.int64()))]))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): the seeds and other identifiers of each row, with their patterns."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(_NAMES, x)) for x in occurrences(t)] for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _ARROW_SPANS)], ["id", "found"])
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("found", ArrayType(_SPAN))])
    return map_batches(texts_and_ids(docs, id_col, text_col), run, schema)


def pattern_confidence(edges: DataFrame, rounds: int = 3, damping: float = 1.0, trusted: float = 0.5) -> DataFrame:
    """(pattern, confidence, seeds) after some rounds of scoring the graph of distinct (pattern, instance, seed)."""
    seeds = edges.select("instance", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score")).groupBy("instance").agg(F.max("score").alias("score"))
    scores = seeds
    for i in range(rounds):
        scored = edges.join(scores, "instance")
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + damping)).alias("confidence"),
                                                 F.count_if("seed").alias("seeds"))
        if i + 1 < rounds:
            known = edges.join(patterns.filter(F.col("confidence") >= trusted), "pattern")
            grown = known.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("grown"))
            scores = written(seeds.join(grown, "instance", "left")
                             .select("instance", F.greatest("score", F.coalesce("grown", F.lit(0.0))).alias("score")), "pii-scores")
    return patterns


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3,
                       min_confidence: float = 0.8, min_seeds: int = 5) -> DataFrame:
    """(id, spans) of every row; a span has start, rank, end, kind and confidence.

    Base spans always stay, with confidence 1; an identifier that a pattern of
    high confidence discovers is added with that confidence. A null text counts
    as empty; an empty text has no spans. Repeated rows and ids are each
    returned, and repeated texts count once in the graph, which holds distinct
    pairs. An empty table gives an empty result.
    """
    found = written(candidates(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii")
    each = found.select("row", F.posexplode("found").alias("k", "s")).select("row", "k", "s.*")
    pairs = each.select("instance", "seed", F.explode("patterns").alias("pattern"))
    edges = written(pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    # written, so that the join deals both sides afresh and can split a pattern that a third of all rows hold
    sure = written(pattern_confidence(edges, rounds).filter((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds)), "pii-patterns")
    unseen = each.filter(~F.col("seed")).select("row", "k", F.explode("patterns").alias("pattern"))
    known = unseen.join(sure, "pattern").groupBy("row", "k").agg(F.max("confidence").alias("confidence"))
    kept = known.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "confidence"))).alias("known"))
    # a base span stays for its kind, another for what the patterns say of its place in the row
    span = lambda s, i: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
                                 F.when(s["seed"], F.lit(1.0)).otherwise(F.element_at("known", i)).alias("confidence"))
    spans = F.filter(F.transform("found", span), lambda s: s["confidence"].isNotNull())
    return found.join(kept, "row", "left").select(F.col("id").alias(id_col), F.array_sort(spans).alias("spans"))
