"""Model requests and answer acquisition.

What a request says before the document depends on the schema alone: a frame of
one row per kind of request, made by column expressions over the spec frame.
Answers come from a recorded table (an equi-join) or from a client called in
``mapInPandas``. Every call leaves a row in a ledger on shared storage: its
answer or its error. Calls are made in waves, and a wave is committed before the
next one starts, so whatever ends a study, the answers paid for so far stay. A
later study asks what has no answer yet: what was never asked, what failed, and
what is asked in other words, as the prompt's hash is part of the key.
"""
from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..spec import Schema, spec_frame

# Request wording (the same text the reference sends).
CONSTRAINED_HEAD = ("Extract the fields below from the document. "
                    "Respond with a single JSON object matching this schema, nothing else.\n")
FREEFORM_HEAD = ("Read the document and report every field listed below, one per line, "
                 "using the exact field name, e.g. '{example}: <value>'. Plain text only.\n")
ARBITER_HEAD = ("From the document, what is the value of this field? "
                "Answer with the value only, nothing else.\n")
ARBITER_OPTIONAL = "If the document does not state it, answer NONE.\n"
MULTI_HINT = " [list ALL values, separated by '; ']"


def _listed(text: Column, separator: str) -> Column:
    """An aggregate: the texts of all fields in schema order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))), lambda x: x["text"]), separator)


def _property() -> Column:
    """A field's entry in the JSON Schema: a scalar, inside an array for lists, then the description."""
    scalar = F.concat(F.lit('{"type": "'), F.when(F.col("type").isin("number", "integer"), F.col("type")).otherwise("string"),
                      F.when(F.col("type") == "date", '", "format": "date"').otherwise('"'),
                      F.when(F.size("enum") > 0, F.concat(F.lit(', "enum": '), "enum_json")).otherwise(""))
    whole = F.when(F.col("multi"), F.concat(F.lit('{"type": "array", "items": '), scalar, F.lit("}"))).otherwise(scalar)
    told = F.when(F.col("description") != "", F.concat(F.lit(', "description": '), "description_json")).otherwise("")
    return F.concat("field_json", F.lit(": "), whole, told, F.lit("}"))


def _line() -> Column:
    """A field's line in the block of fields; it says nothing of absence."""
    options = F.array_join(F.transform("enum", lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    return F.concat(F.lit("- "), "field", F.lit(" ("), "type", F.lit(")"), F.when(F.size("enum") > 0, F.concat(F.lit(" one of ["), options, F.lit("]"))).otherwise(""),
                    F.when(F.col("multi"), MULTI_HINT).otherwise(""), F.when(F.col("description") != "", F.concat(F.lit(" — "), "description")).otherwise(""))


def request_heads(spark: SparkSession, schema: Schema) -> DataFrame:
    """(path, field, force_json, head): what each kind of request says before the
    document. Two rows for the extractions and one per field for the arbiter."""
    spec = spec_frame(spark, schema)
    parts = spec.agg(_listed(_property(), ", ").alias("properties"), _listed(_line(), "\n").alias("lines"), F.min_by("field", "ord").alias("first"),
                     F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("ord", "field_json")))), lambda x: x["field_json"]), ", ").alias("needed"))
    tail = F.concat(F.lit("FIELDS:\n"), "lines", F.lit("\nDOCUMENT:\n"))
    form = F.concat(F.lit('JSON SCHEMA:\n{"type": "object", "properties": {'), "properties", F.lit('}, "required": ['), "needed", F.lit('], "additionalProperties": false}\n'))
    before, after = FREEFORM_HEAD.split("{example}")
    kind = lambda path, forced, head: F.struct(F.lit(path).alias("path"), F.lit("").alias("field"), F.lit(forced).alias("force_json"), head.alias("head"))
    extraction = parts.select(F.inline(F.array(kind("constrained", True, F.concat(F.lit(CONSTRAINED_HEAD), form, tail)),
                                               kind("unconstrained", False, F.concat(F.lit(before), "first", F.lit(after), tail)))))
    asked = F.concat(F.lit(ARBITER_HEAD + "FIELD: "), "field", F.lit("\nTYPE: "), "type", F.lit("\n"),
                     F.when(F.col("description") != "", F.concat(F.lit("DESCRIPTION: "), "description", F.lit("\n"))).otherwise(""),
                     F.when(F.col("required"), "").otherwise(ARBITER_OPTIONAL), F.lit("DOCUMENT:\n"))
    arbiter = spec.select(F.lit("arbiter").alias("path"), "field", F.lit(False).alias("force_json"), asked.alias("head"))
    return extraction.unionByName(arbiter)


def _prompt() -> Column:
    return F.concat("head", "document", F.lit("\n")).alias("prompt")


def extraction_requests(documents: DataFrame, schema: Schema, run_id: str) -> DataFrame:
    """Two requests per document: (run_id, doc_id, path, field, force_json, prompt)."""
    heads = request_heads(documents.sparkSession, schema).filter("path <> 'arbiter'").collect()
    both = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("path", "field", "force_json", "head"))) for r in heads))
    return (documents.select("doc_id", "document", F.inline(both))
            .select(F.lit(run_id).alias("run_id"), "doc_id", "path", "field", "force_json", _prompt()))


def arbiter_requests(worklist: DataFrame, documents: DataFrame, schema: Schema) -> DataFrame:
    """One blind request per flagged field (the candidates are not shown)."""
    heads = F.broadcast(request_heads(documents.sparkSession, schema).filter("path = 'arbiter'"))  # one row per field
    return (worklist.join(heads, "field").join(documents.select("doc_id", "document"), "doc_id")
            .select("run_id", "doc_id", "path", "field", "force_json", _prompt()))


KEY = ["run_id", "doc_id", "path", "field"]
ASKED = [*KEY, "prompt_sha"]
LEDGER = ("run_id string, doc_id long, path string, field string, prompt_sha string, force_json boolean, prompt string, "
          "raw string, error string, tries int, elapsed_ms long, asked_us long, call string")


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """Every call so far: request, answer (null: none), error (null: none), tries, and when it was made."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{store}/calls")
    except AnalysisException:  # nothing is stored yet
        return spark.createDataFrame([], LEDGER)


def latest(calls: DataFrame) -> DataFrame:
    """One row per request and prompt: its first answer, or its last error; with the tries of all its calls.

    A group is the calls for one request, which are as many as studies that failed to get an answer.
    """
    answered = F.col("error").isNull()
    at = F.when(answered, -F.col("asked_us")).otherwise(F.col("asked_us"))
    best = F.max_by(F.struct("force_json", "prompt", "raw", "error", "elapsed_ms", "asked_us"), F.struct(answered, at, F.col("call")))
    return calls.groupBy(*ASKED).agg(best.alias("best"), F.sum("tries").alias("tries"), F.count("*").alias("calls")).select(*ASKED, "best.*", "tries", "calls")


def with_hash(requests: DataFrame) -> DataFrame:
    return requests.select(*KEY, "force_json", "prompt", F.sha2("prompt", 256).alias("prompt_sha"))


def ask(requests: DataFrame, client_factory: Callable[[], object], store: str, attempts: int = 2, wave: int = 100_000) -> int:
    """Call the client for every request that has no answer in the ledger. Returns how many that were.

    A client made by ``client_factory`` serves one task; ``generate(prompt,
    force_json)`` returns the text. A ``TimeoutError`` is tried again up to
    ``attempts`` times in all; that and any other exception leaves a row with its
    error, and the task goes on. About ``wave`` requests are committed together:
    a lost driver loses the answers of one wave, a lost executor makes a task ask
    again for its own requests. Requests must be distinct in key and prompt.
    """
    spark = requests.sparkSession
    if attempts < 1:
        raise ValueError("attempts must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()

        def call(prompt: str, forced: bool) -> tuple[str | None, str | None, int]:
            for tried in range(1, attempts + 1):
                try:
                    return client.generate(prompt, force_json=forced), None, tried
                except TimeoutError as e:
                    error = e
                except Exception as e:  # noqa: BLE001 -- what a call raises is its result
                    return None, f"{type(e).__name__}: {e}", tried
            return None, f"{type(error).__name__}: {error}", attempts
        for pdf in batches:
            rows = []
            for prompt, forced in zip(pdf["prompt"], pdf["force_json"]):
                began, now = time.perf_counter(), time.time_ns() // 1000
                rows.append((*call(prompt, bool(forced)), int((time.perf_counter() - began) * 1000), now, uuid.uuid4().hex))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["raw", "error", "tries", "elapsed_ms", "asked_us", "call"])], axis=1)
    wanted = with_hash(requests)
    answers = ledger(spark, store).filter("error is null").select(*ASKED)
    todo = scratch_path(spark, "requests")
    missing = wanted.join(answers, ASKED, "left_anti")
    missing.write.parquet(f"{todo}/all")
    left = spark.read.schema(missing.schema).parquet(f"{todo}/all")
    total = left.count()
    waves = max(1, -(-total // wave))
    number = F.pmod(F.xxhash64(*ASKED), F.lit(waves)).cast("int")
    if waves > 1:  # so that a wave reads its own requests only
        left.withColumn("wave", number).repartition("wave").write.partitionBy("wave").parquet(f"{todo}/waves")
    for i in range(waves if total else 0):
        part = spark.read.schema(missing.schema).parquet(f"{todo}/waves/wave={i}") if waves > 1 else left
        spread = part.repartition(spark.sparkContext.defaultParallelism)
        spread.select(*ASKED, "force_json", "prompt").mapInPandas(run, LEDGER).write.mode("append").parquet(f"{store}/calls")
    return total


def acquire(requests: DataFrame, client_factory: Callable[[], object], store: str | None = None, attempts: int = 2, wave: int = 100_000) -> DataFrame:
    """The answers to all requests that have one, with their prompts (T3 log); ``ask`` says what is asked.

    ``store`` is the ledger's folder on shared storage (default: a new one). A
    request without an answer has no row here, and its errors in ``ledger``; an
    answer to other words of the same request is not an answer.
    """
    spark = requests.sparkSession
    store = store or scratch_path(spark, "responses")
    ask(requests, client_factory, store, attempts, wave)
    found = latest(ledger(spark, store).filter("error is null"))
    return found.join(with_hash(requests).select(*ASKED), ASKED, "left_semi").select(*KEY, "force_json", "prompt", "raw", "elapsed_ms")


def acquire_recorded(worklist: DataFrame, answer_book: DataFrame) -> DataFrame:
    """Recorded source: the answers for exactly the requested keys (equi-join)."""
    return answer_book.join(worklist.select("run_id", "doc_id", "field"),
                            ["run_id", "doc_id", "field"], "left_semi")


def extractions_from_responses(responses: DataFrame) -> DataFrame:
    """Two extraction responses per document -> (run_id, doc_id, constrained_raw,
    unconstrained_raw); a group is one document's two answers."""
    return (responses.filter(F.col("path").isin("constrained", "unconstrained"))
            .groupBy("run_id", "doc_id")
            .agg(F.max(F.when(F.col("path") == "constrained", F.col("raw"))).alias("constrained_raw"),
                 F.max(F.when(F.col("path") == "unconstrained", F.col("raw"))).alias("unconstrained_raw")))
