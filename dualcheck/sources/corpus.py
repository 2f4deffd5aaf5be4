"""Corpus sources, converters and dataset QA."""
from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, small_or_dealt
from ..spec import FieldSpec, Schema

# Long-contract reduction (head/tail sizes, window, keywords,
# separator) and the literal escapes found in TSV exports.
HEAD, TAIL, WINDOW = 3000, 1500, 700
CLAUSE_KEYWORDS = ("governed by", "governing law", "laws of the", "term of this agreement",
                   "shall remain in effect", "shall terminate", "period of")
PART_SEP = "\n[...]\n"
# The patterns that decide a gold value's type.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
DMY_DATE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$"
NUMBERISH = r"^[-+]?[\d,]*\.?\d+$"


def numbered(rows: DataFrame, name: str = "doc_idx") -> DataFrame:
    """Rows with their place in the input's order, from 0.

    Spark's row ids count up within a partition; adding what earlier partitions
    hold makes them consecutive. Only one count per partition is gathered.
    """
    ids = rows.withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ids.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (ids.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + place).drop("_id", "_part", "_before"))


#: The place of a line among all files of a source: its file, the split of the file, and its place there.
PLACE = ("_file", "_split", "_id")


def file_lines(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Lines of one or many text files with their ``PLACE``; with ``only``, those that match this pattern.

    Splits of a file are read apart, and several small files by one task, in an
    order that depends on their sizes. A line's file, its split's offset in the
    file and a number that counts up as a task reads give back the order: files
    by their path, lines as they stand.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    return (lines.filter(F.col("value").rlike(only)) if only else lines).withColumn("_id", F.monotonically_increasing_id())


def split_offsets(lines: DataFrame, **sums: Column) -> DataFrame:
    """One row per split: ``_first``, the least ``_id`` there, and for each sum what all earlier splits hold, as ``<name>_before``.

    Offsets have two levels: files among all, and splits within a file, so that
    no task sees more than one row per file or the splits of one.
    """
    splits = materialize(lines.groupBy("_file", "_split").agg(F.min("_id").alias("_first"), *(c.alias(n) for n, c in sums.items())), "splits")
    files = splits.groupBy("_file").agg(*(F.sum(n).alias(n) for n in sums))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_of_files") for n in sums))
    inside = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.join(files, "_file").select("_file", "_split", "_first", *(
        (F.col(f"_{n}_of_files") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in sums))


def numbered_lines(lines: DataFrame, name: str = "doc_idx") -> DataFrame:
    """Lines with their place in the order of files and lines, from 0. A filter must come before ``_id`` is given."""
    offsets = small_or_dealt(materialize(split_offsets(lines, n=F.count("*")), "line-offsets"))
    return lines.join(offsets, ["_file", "_split"]).withColumn(name, F.col("n_before") + F.col("_id") - F.col("_first")).drop("n_before", "_first", *PLACE)


def _gold_text(value) -> F.Column:
    """A gold value as text: a list's elements joined by "; ", true and false as
    True and False, null as None, anything else as it is written."""
    kind = F.schema_of_variant(value)
    items = F.array_join(F.try_variant_get(value, "$", "array<string>"), "; ", "None")
    return (F.when(kind.startswith("ARRAY"), items).when(kind == "VOID", F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(value.cast("string"))).otherwise(value.cast("string")))


def _records(lines: DataFrame, *keep: str) -> DataFrame:
    """(…, document, gold MAP<STRING,VARIANT>) of JSON lines; a line that is no JSON raises."""
    rec = F.from_json("value", "document string, gold map<string,variant>", {"mode": "FAILFAST"})
    return lines.select(*keep, rec.alias("r")).select(*keep, "r.document", "r.gold")


def read_jsonl_corpus(spark: SparkSession, path: str) -> DataFrame:
    """{"document", "gold"} lines -> (doc_idx, document, gold MAP<STRING,STRING>).

    Blank lines are skipped, bad lines raise, and so does an empty corpus. The
    index follows the order of the files' paths and of the lines in each.
    """
    lines = file_lines(spark, path, r"\S")
    if lines.isEmpty():
        raise ValueError(f"no records in {path}")
    return _records(numbered_lines(lines), "doc_idx").select("doc_idx", "document", F.transform_values("gold", lambda k, v: _gold_text(v)).alias("gold"))


def infer_type(value) -> F.Column:
    """S2 rule for one scalar gold value."""
    v = F.trim(value)
    return (F.when(v.rlike(ISO_DATE) | v.rlike(DMY_DATE), F.lit("date"))
            .when(v.rlike(NUMBERISH), F.lit("number")).otherwise(F.lit("string")))


def infer_schema(spark: SparkSession, path: str, name: str = "external") -> Schema:
    """Field spec from the first record's gold (types from raw values;
    lists -> multi with the first element's type). A few rows to the driver."""
    first = _records(file_lines(spark, path, r"\S").orderBy(*PLACE).limit(1))
    ent = first.select(F.posexplode(F.map_entries("gold")).alias("ord", "e")).select("ord", F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    multi = F.schema_of_variant("v").startswith("ARRAY")
    element = F.coalesce(F.try_element_at(F.try_variant_get("v", "$", "array<string>"), F.lit(1)), F.lit(""))
    rows = ent.select("k", multi.alias("multi"), infer_type(F.when(multi, element).otherwise(_gold_text(F.col("v")))).alias("t"), "ord").orderBy("ord").collect()
    return Schema(name, tuple(FieldSpec(r["k"], r["t"], multi=bool(r["multi"])) for r in rows))


def _stem() -> Column:
    """The file's own name without its ending. Spark gives names as part of a URI, so that a blank is "%20" and "%" is "%25"."""
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.[^.]*$", "").alias("stem")


def read_boxes(spark: SparkSession, box_dir: str) -> DataFrame:
    """The files of OCR boxes, whole: (stem, value). The stem is the file's own name without its ending, whatever characters it has."""
    return spark.read.text(box_dir, wholetext=True).select(_stem(), "value")


def box_text(boxes: DataFrame) -> DataFrame:
    """OCR boxes (x1..y4,text; one a line) -> (stem, document), lines in file order.

    Each row is split on the first 8 commas; rows with 9 parts keep the text.
    """
    texts = F.regexp_extract_all(F.col("value"), F.lit(r"(?m)^(?:[^,\r\n]*,){8}([^\r\n]*)$"), 1)
    return boxes.select("stem", F.array_join(texts, "\n").alias("document"))


def box_to_text(spark: SparkSession, box_dir: str) -> DataFrame:
    return box_text(read_boxes(spark, box_dir))


def read_keys(spark: SparkSession, key_dir: str, names: tuple[str, ...]) -> DataFrame:
    """Key files, one JSON object each: (stem, one column per name; null where the file has none)."""
    files = spark.read.text(key_dir, wholetext=True).select(_stem(), "value")
    return keys_of(files, names)


def keys_of(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Key records of whole files (stem, value)."""
    rec = F.from_json("value", ", ".join(f"`{n}` string" for n in names), {"mode": "FAILFAST"})
    return files.select("stem", rec.alias("r")).select("stem", "r.*")


def receipts(boxes: DataFrame, keys: DataFrame, required=("company", "date", "address", "total")) -> DataFrame:
    """(stem, document, gold) of the receipts that have text and every
    required key. They are joined on the file stem and left unordered: a reader that needs the order of names
    sorts by stem, as ``write_corpus`` does."""
    there = F.col("document") != ""
    for k in required:
        there = there & F.col(f"`{k}`").isNotNull()
    gold = F.create_map(*(x for k in required for x in (F.lit(k), F.col(f"`{k}`"))))
    return boxes.join(keys, "stem").filter(there).select("stem", "document", gold.alias("gold"))


def unescape(text) -> F.Column:
    """Literal \\n, \\t, \\r escapes from TSV exports (before truncation)."""
    t = F.replace(text, F.lit("\\n"), F.lit("\n"))
    t = F.replace(t, F.lit("\\t"), F.lit("\t"))
    return F.replace(t, F.lit("\\r"), F.lit(""))


def clause_reduce(docs: DataFrame, text: str = "text", head_chars: int = HEAD, tail_chars: int = TAIL, window: int = WINDOW) -> DataFrame:
    """Long documents keep head, tail and merged keyword windows of the middle.

    The three sizes decide what of a long document is kept; ``dropped`` counts
    the characters that ``reduced`` doesn't hold, and ``kept_spans`` says where
    (from, to, from 0) its parts stand in the unescaped text. Only ``reduced``
    is shortened: the text itself stays for grounding.
    """
    t = unescape(F.col(text))
    x = docs.withColumn("_t", t).withColumn("_L", F.length("_t"))
    mid = F.substring(F.col("_t"), F.lit(head_chars + 1), F.col("_L") - head_chars - tail_chars)
    x = x.withColumn("_mid", mid).withColumn("_low", F.lower("_mid"))
    spans = F.array_compact(F.array(*[
        F.when(F.instr("_low", kw) > 0, F.struct(
            F.greatest(F.instr("_low", kw) - 1 - window // 2, F.lit(0)).alias("a"),
            (F.instr("_low", kw) - 1 + window).alias("b"))) for kw in CLAUSE_KEYWORDS]))
    merged = F.aggregate(F.array_sort(spans), F.array().cast("array<struct<a:int,b:int>>"),
                         lambda acc, s: F.when(
                             (F.size(acc) > 0) & (s["a"] <= F.element_at(acc, -1)["b"]),
                             F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                                 F.element_at(acc, -1)["a"].alias("a"),
                                 F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b")))))
                         .otherwise(F.concat(acc, F.array(s))))
    windows = F.array_join(F.transform(merged, lambda s: F.substring(F.col("_mid"), s["a"] + 1, s["b"] - s["a"])),
                           PART_SEP)
    head = F.substring("_t", 1, head_chars)
    tail = F.substring("_t", -tail_chars, tail_chars)
    reduced = F.array_join(F.filter(F.array(head, windows, tail), lambda p: p != ""), PART_SEP)
    long = F.col("_L") > head_chars + tail_chars
    span = lambda a, b: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"))
    middle = F.transform(merged, lambda s: span(s["a"] + head_chars, F.least(s["b"] + head_chars, F.col("_L") - tail_chars)))
    parts = F.when(long, F.concat(F.array(span(F.lit(0), F.lit(head_chars))), middle, F.array(span(F.col("_L") - tail_chars, F.col("_L"))))) \
        .otherwise(F.array(span(F.lit(0), F.col("_L"))))
    x = x.withColumn("reduced", F.when(long, reduced).otherwise(F.col("_t"))).withColumn("kept_spans", parts)
    kept = F.aggregate("kept_spans", F.lit(0), lambda acc, s: acc + s["to"] - s["from"])
    return x.withColumn("dropped", F.col("_L") - kept).drop("_t", "_L", "_mid", "_low")


def corpus_shape(docs: DataFrame) -> DataFrame:
    """Q1: record count, non-blank documents, languages, sources, size range."""
    return docs.agg(F.count("*").alias("records"),
                    F.count_if(F.trim("text") != "").alias("non_blank"),
                    F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"),
                    F.min(F.length("text")).alias("min_chars"), F.max(F.length("text")).alias("max_chars"))


def gold_keys(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Q1: whether every record has exactly these gold keys and a document that isn't blank, and how many lack or add some."""
    keys, wanted = F.map_keys("gold"), F.array(*map(F.lit, names))
    lacks, adds = F.size(F.array_except(wanted, keys)) > 0, F.size(F.array_except(keys, wanted)) > 0
    return docs.agg(F.count("*").alias("records"), F.count_if(F.col("document").rlike(r"\S")).alias("non_blank"), F.count_if(lacks).alias("lacking"),
                    F.count_if(adds).alias("adding"), F.coalesce(F.bool_and(~lacks & ~adds), F.lit(True)).alias("exact"))


def escape_residue(docs: DataFrame) -> DataFrame:
    """Q2: literal backslash escapes (newline and tab) left in text, and documents with real newlines."""
    return docs.agg(F.sum(F.regexp_count("text", F.lit(r"\\n"))).alias("literal_newlines"),
                    F.sum(F.regexp_count("text", F.lit(r"\\t"))).alias("literal_tabs"),
                    F.count_if(F.instr("text", "\n") > 0).alias("docs_with_newline"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Q5: content fingerprint per document."""
    return docs.select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))


def corpus_digest(fp: DataFrame) -> DataFrame:
    """Q5 corpus digest, tied to the ids, combined by sums (no single-task
    collection): sha256(id ':' sha) as four numbers of 64 bits, each summed
    over the corpus, so that all 256 bits of every hash count."""
    digest = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "sha256"), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
            for at in (1, 17, 33, 49)]
    return fp.agg(F.count("*").alias("records"), F.concat_ws("-", *sums).alias("digest"))


def same_corpus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q5: whether two fingerprint tables hold the same documents: counts on each
    side and of ids with equal and with different content."""
    both = a.select("doc_id", F.col("sha256").alias("a")).join(b.select("doc_id", F.col("sha256").alias("b")), "doc_id", "full_outer")
    return both.agg(F.count("a").alias("left_records"), F.count("b").alias("right_records"), F.count_if(F.col("a") == F.col("b")).alias("equal"),
                    F.count_if(F.col("a") != F.col("b")).alias("different")).withColumn(
        "identical", (F.col("left_records") == F.col("equal")) & (F.col("right_records") == F.col("equal")))


def corpus_sample(docs: DataFrame, by: str = "corpus", n: int = 6, order: str = "doc_id") -> DataFrame:
    """First n documents per group (a per-group limit applied before the
    shuffle by Spark's window group limit)."""
    w = Window.partitionBy(by).orderBy(order)
    return docs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def corpus_catalog(spark: SparkSession, corpora: dict[str, str], n: int = 6) -> DataFrame:
    """The first ``n`` documents of every corpus that is there, and a row for each that isn't.

    (corpus, present, records, doc_idx, document): paths are asked one by one, as
    a source that lacks one of several paths gives nothing at all; what is there
    is then read as one source, so a thousand corpora are one job. An absent
    corpus has no records and nulls.
    """
    def there(path: str) -> bool:
        try:  # lists the folder; no content is read
            return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
        except AnalysisException:
            return False
    found = {name: there(path) for name, path in corpora.items()}
    rows = spark.createDataFrame([(c, p) for c, p in found.items()], "corpus string, present boolean")
    none = rows.filter("not present").select("corpus", "present", F.lit(0).cast("long").alias("records"), F.lit(None).cast("long").alias("doc_idx"), F.lit(None).cast("string").alias("document"))
    parts = [file_lines(spark, corpora[c], r"\S").select(F.lit(c).alias("corpus"), "value", *PLACE) for c, p in found.items() if p]
    if not parts:
        return none
    lines = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("corpus").orderBy(*PLACE)
    first = lines.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    counts = lines.groupBy("corpus").agg(F.count("*").alias("records"))
    some = _records(first, "corpus", "rank").join(counts, "corpus").select("corpus", F.lit(True).alias("present"), "records", (F.col("rank") - 1).cast("long").alias("doc_idx"), "document")
    return some.unionByName(none)


def label_lines(documents: DataFrame, scalars: tuple[str, ...], list_key: str) -> DataFrame:
    """Render gold maps as 'key=value' label lines (spaces as '_'; the list key
    repeated per element; empty values left out), the shape S9 parses."""
    g = F.col("gold")
    enc = lambda c: F.regexp_replace(c, " ", "_")
    each = F.transform(F.filter(F.split(F.element_at(g, F.lit(list_key)), "; "), lambda x: x != ""),
                       lambda x: F.concat(F.lit(f"{list_key}="), enc(x)))
    one = [F.when(F.element_at(g, F.lit(k)) != "", F.concat(F.lit(f"{k}="), enc(F.element_at(g, F.lit(k))))) for k in scalars]
    return documents.select("doc_id", F.concat_ws(" ", *one, F.array_join(each, " ")).alias("line"))


def parse_label_lines(lines: DataFrame, scalars: tuple[str, ...], list_key: str) -> DataFrame:
    """S9: 'key=value' tokens, '_' -> space; missing scalars -> "" (last value
    wins), every ``list_key`` value collected in order."""
    def values(k: str):
        return F.regexp_extract_all(F.col("line"), F.lit(rf"(?:^|\s){k}=(\S*)"), 1)
    out = [F.coalesce(F.replace(F.try_element_at(values(k), F.lit(-1)), F.lit("_"), F.lit(" ")),
                      F.lit("")).alias(k) for k in scalars]
    lst = F.array_join(F.transform(values(list_key), lambda v: F.replace(v, F.lit("_"), F.lit(" "))), "; ")
    return lines.select("doc_id", *out, lst.alias(list_key))


def provenance_diff(parsed: DataFrame, documents: DataFrame) -> DataFrame:
    """Q4: row-aligned comparison of parsed labels with the source gold (after
    the same '_' -> space decoding); matches / total per field."""
    cols = [c for c in parsed.columns if c != "doc_id"]
    src = documents.select("doc_id", *[F.replace(F.coalesce(F.element_at("gold", F.lit(c)), F.lit("")),
                                                 F.lit("_"), F.lit(" ")).alias(f"src_{c}") for c in cols])
    j = parsed.join(src, "doc_id", "full_outer")
    return j.agg(F.count("*").alias("total"), *[
        F.count_if(F.col(c).eqNullSafe(F.col(f"src_{c}"))).alias(f"{c}_match") for c in cols])
