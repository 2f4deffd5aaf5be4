"""Secret scans that tell copied examples from live credentials by ownership.

Fixed patterns find credentials in each text; long tokens of mixed characters
and high entropy are further candidates. The hashes of all candidates are then
counted over the whole corpus by distinct repository and owner. A value that
many owners have is a widely copied example, one of few owners is a credential.
Found patterns carry this verdict unless their value is a placeholder; other
tokens must look live besides and are added to the spans under the kind ``live``.

Only hashes leave the texts. They are counted by owner and repository first, so
a value that every row holds shuffles no more than one row per owner and task.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import MARK, identity, map_batches, texts_and_ids, written

KINDS = ("assign", "access", "hex")
LIVE = "live"

# The patterns that define the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
#: Words that mark an example where no letter stands beside them.
PLACEHOLDER = re.compile(r"(?<![A-Za-z])(?i:example|sample|dummy|change[-_]?me|your|test|placeholder|redacted)(?![A-Za-z])", re.A)
#: Stretches that no random key is mostly made of.
FILLER = re.compile(r"(?i:example|sample|dummy|changeme|your|test|placeholder|redacted)|([A-Za-z0-9*.])\1{3,}|0?123456(?:7(?:8(?:90?)?)?)?|abcdef(?:gh)?", re.A)

#: Values of this many owners or more are copied examples.
SHARED_OWNERS = 5
#: Bits a character, at least, for a value to look live.
MIN_ENTROPY = 2.8


def placeholder(value: str) -> bool:
    """Whether a word that marks an example stands in it as a whole, or half of it or more is filler."""
    return bool(PLACEHOLDER.search(value)) or 2 * sum(m.end() - m.start() for m in FILLER.finditer(value)) >= len(value)


def looks_live(value: str, min_entropy: float = MIN_ENTROPY) -> bool:
    """For candidates of no base kind: long, varied characters, digits among letters, and no placeholder."""
    n = len(value)
    if n < 12 or placeholder(value) or not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= min_entropy


def scan(text: str) -> list[tuple[int, int, int, str, str]]:
    """(start, rank, end, kind, value) of the base spans, then of the other candidates (kind ``live``)."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for s, _, e, _, _ in found)
    at = 0
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        if not (at < len(base) and base[at][0] < m.end()) and looks_live(m[0]):
            found.append((m.start(), 3, m.end(), LIVE, m[0]))
    return found


_SPAN = StructType([StructField("start", LongType()), StructField("rank", LongType()), StructField("end", LongType()),
                    StructField("kind", StringType()), StructField("value", LongType()), StructField("looks", BooleanType())])
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int64()), ("end", pa.int64()), ("kind", pa.string()),
                                   ("value", pa.int64()), ("looks", pa.bool_())]))


def _hashed(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source",
               owner_col: str = "source") -> DataFrame:
    """(id, repo, owner, found) with the spans and hashed values of each row."""
    rows = texts_and_ids(docs, id_col, text_col, repo_col, owner_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        # scan() has judged candidates of no base kind already
        found = [[(s, r, e, k, _hashed(v), k == LIVE or not placeholder(v)) for s, r, e, k, v in scan(t)] for t in b.column(1).to_pylist()]
        spans = [[dict(zip(("start", "rank", "end", "kind", "value", "looks"), x)) for x in row] for row in found]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(spans, _ARROW_SPANS)],
                                          ["id", "repo", "owner", "found"])
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("repo", StringType()),
                         StructField("owner", StringType()), StructField("found", ArrayType(_SPAN))])
    text_keys = rows.withColumn("c0", F.col("c0").cast("string")).withColumn("c1", F.col("c1").cast("string"))
    return map_batches(text_keys, run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """(value, repos, owners, holders): in how many distinct repositories and owners each value occurs. Holders are its
    owners, the repositories of rows without an owner, and the documents of rows with neither."""
    alone = F.col("owner").isNull() & F.col("repo").isNull()
    each = (found.select("owner", "repo", F.when(alone, F.xxhash64("id")).alias("doc"), F.explode("found.value").alias("value"))
            .groupBy("value", "owner", "repo", "doc").agg(F.lit(1).alias("one")))
    repos = F.count_distinct(F.when(F.col("owner").isNull(), F.col("repo")))
    counted = each.groupBy("value").agg(F.count_distinct("owner", "repo").alias("repos"), F.count_distinct("owner").alias("owners"),
                                        repos.alias("ownerless"), F.count("doc").alias("docs"))
    return counted.select("value", "repos", "owners", (F.col("owners") + F.col("ownerless") + F.col("docs")).alias("holders"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source",
                 owner_col: str = "source", shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """(id, spans) of every row; a span has start, rank, end, kind, owners, repos and live.

    Base spans always stay; ``live`` says whether the value is no placeholder
    and has fewer than ``shared_owners`` holders: owners, repositories of rows without an
    owner, and documents (distinct ids) of rows with neither. Candidates of no base kind
    are returned only if they look live and have so few. A null text counts as empty; an empty text has no spans.
    Rows without an owner add to neither ``owners`` nor ``repos``. Repeated rows and
    ids are each returned. An empty table gives an empty result.
    """
    found = written(candidates(docs, id_col, text_col, repo_col, owner_col)
                    .withColumn("row", F.monotonically_increasing_id()), "secrets")
    # written, so that the join deals both sides afresh and can split a value that a third of all rows hold
    owners = written(ownership(found), "secret-owners")
    each = found.select("row", F.explode("found").alias("s")).select("row", "s.*").join(owners, "value", "left")
    live = F.col("looks") & (F.coalesce("holders", F.lit(0)) < shared_owners)
    judged = each.withColumn("live", live).filter((F.col("rank") < len(KINDS)) | F.col("live"))
    span = F.struct("start", "rank", "end", "kind", F.coalesce("owners", F.lit(0)).alias("owners"),
                    F.coalesce("repos", F.lit(0)).alias("repos"), "live")
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return (found.select("row", "id").join(spans, "row", "left")
            .select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans")))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source",
             shared_owners: int = SHARED_OWNERS, mask: str = "[SECRET]") -> DataFrame:
    """``docs``, all rows and columns, with the live spans of ``find_secrets`` replaced by ``mask`` in ``text_col``.

    Widely copied examples stay. Overlapping spans are replaced once. Rows
    without live spans keep their text, null included.
    """
    marked = docs.withColumn(MARK, identity(docs, id_col, text_col))
    found = find_secrets(marked, MARK, text_col, repo_col, owner_col, shared_owners)
    live = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    spans = found.select(MARK, live.alias("live")).filter(F.size("live") > 0).dropDuplicates([MARK])
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = marked.select(MARK, row).join(spans, MARK, "left")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, live in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if text is not None and live:
                parts, at = [], 0
                for s in sorted(live, key=lambda s: (s["start"], s["end"])):
                    if s["start"] >= at:
                        parts += [text[at:s["start"]], mask]
                    at = max(at, s["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["row", "text"])
    text = F.col("row").getField(text_col).cast("string").alias("text")
    schema = StructType([StructField("row", docs.select(row).schema["row"].dataType), StructField("text", StringType())])
    done = map_batches(rows.select("row", text, "live"), run, schema)
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
