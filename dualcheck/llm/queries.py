"""Registered queries: each applies its operator to the whole of its table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backtrack_bpe, bit_sliced, byte_bpe, chat_format, collocations, pii_patterns, secret_scan, turn_repair, url_filter, vector_packing
from .fertility import quality
from .simhash import near_duplicates
from .spans import digest
from .suffix_dedup import removed

#: Names of public vocabulary files; where they lie is asked when a query runs.
PIECE, MULTI, WORD_BPE, BYTE_BPE = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, tokeniser fertility and the verdict of the language's bands for every document."""
    return quality(_table(spark, sf_dir, "documents"), vocabulary(PIECE), vocabulary(MULTI))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the strings of 200 bytes that also start elsewhere."""
    return removed(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, judged by how many owners in the corpus have the value.

    A source is an owner; its documents of one language are a repository. Documents without a source have neither.
    """
    docs = _table(spark, sf_dir, "documents").withColumn("repo", F.when(F.col("source").isNotNull(), F.concat_ws("/", "source", "lang")))
    out = secret_scan.find_secrets(docs, repo_col="repo")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return out.select("doc_id", *digest(F.col("spans"), secret_scan.KINDS), live)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens by vector bin packing; every token of a document bears loss."""
    out = vector_packing.pack(_table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op5_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with begin and end ids, and decoded."""
    out = backtrack_bpe.encode(_table(spark, sf_dir, "documents"), vocabulary(PIECE))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


#: The rules that the task states.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, or by trees trained on what the rules decide."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each vector whose id is divisible by 20, against all vectors."""
    vectors = _table(spark, sf_dir, "embeddings")
    return bit_sliced.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document by fixed patterns and by patterns learned from their contexts."""
    out = pii_patterns.find_personal_data(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *digest(F.col("spans"), pii_patterns.KINDS))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes the template's marks, formatted, encoded and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)], rows.schema)
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(more), vocabulary(BYTE_BPE)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and components of links of three bits at most."""
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by the task's rule, its faults, the cheapest repair and what it leads to."""
    return turn_repair.repair_report(turn_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by ranks in overlapping chunks, and decoded."""
    import public_tokenizers
    out = byte_bpe.encode(_table(spark, sf_dir, "documents"), vocabulary(MULTI), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith("op")}


#: The same counts by plain grouping; HUGEINT holds the products.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS place, regexp_extract_all(piece, '[^ \t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
words AS (SELECT lang, place, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM pieces),
follow AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY place ORDER BY i)),
f1 AS (SELECT lang, x, count(*) AS f FROM follow GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM follow WHERE y IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM follow WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
two AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, p.f AS l, q.f AS r, (1000000::HUGEINT * c.f * c.f) // (p.f::HUGEINT * q.f) AS score
  FROM f2 c JOIN f1 p ON p.lang = c.lang AND p.x = c.x JOIN f1 q ON q.lang = c.lang AND q.x = c.y LEFT JOIN longer ON longer.lang = c.lang AND longer.x = c.x AND longer.y = c.y
  WHERE c.f >= 10 AND (most IS NULL OR 100 * most < 50 * c.f)),
cuts AS (
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.f AS a, p.f AS l1, q.f AS r1, (1000000::HUGEINT * c.f * c.f) // (p.f::HUGEINT * q.f) AS s1,
         u.f AS l2, v.f AS r2, (1000000::HUGEINT * c.f * c.f) // (u.f::HUGEINT * v.f) AS s2
  FROM f3 c JOIN f1 p ON p.lang = c.lang AND p.x = c.x JOIN f2 q ON q.lang = c.lang AND q.x = c.y AND q.y = c.z
  JOIN f2 u ON u.lang = c.lang AND u.x = c.x AND u.y = c.y JOIN f1 v ON v.lang = c.lang AND v.x = c.z),
every AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def _turn_repair_sql() -> str:
    """The cheapest edits row by row: for each state of the pattern the least (cost, edits) so far and the lines they leave."""
    def then(state: str, cost: str, edit: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def line(role: str) -> str:
        return f"chr(10) || {role} || ':' || text"
    put = {role: f"chr(10) || '{role}:'" for role in ("user", "assistant")}
    keep = lambda state, kind: f"CASE WHEN kind = '{kind}' AND NOT gone THEN {then(state, 'cut', 'K', line('role'))} END"
    give = lambda state, role: f"CASE WHEN NOT gone THEN {then(state, '(2 + cut)', 'R', line(repr(role)))} END"
    drop = lambda state: then(state, "3", "D")
    to_user = [x for state in ("e", "s", "a") for x in (keep(state, "u"), give(state, "user"))]
    raw = (f"{drop('e')} AS e, {least(drop('s'), keep('e', 's'))} AS s, {least(drop('u'), *to_user)} AS u, {least(drop('a'), keep('u', 'a'), give('u', 'assistant'))} AS a")
    user = least("u", *(then(x, "2", "I", put["user"]) for x in ("e", "s", "a")))
    closed = lambda source: (f"SELECT conv, i, e, s, u, {least('a', then('u', '2', 'I', put['assistant']))} AS a FROM (SELECT conv, i, e, s, {user} AS u, a FROM ({source}))")
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    start = f"SELECT DISTINCT conv_id AS conv, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}}::{kind} AS e, NULL::{kind} AS s, NULL::{kind} AS u, NULL::{kind} AS a FROM conversations"
    bits = ", ".join(["-1"] * 8)
    return rf"""
WITH RECURSIVE hashed AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), {bits}])),
             lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, 4294967295), 4294967295) % 20 AS h
  FROM conversations),
there AS (
  SELECT conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END))
  FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM there),
faults AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open, left(role, 1) AS kind, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS kind_before
  FROM placed),
r AS (SELECT *, blank OR again AS gone, CAST(open AS INTEGER) AS cut FROM faults),
f AS (
  {closed(start)}
  UNION ALL
  {closed(f"SELECT f.conv, r.i, {raw} FROM f JOIN r ON r.conv IS NOT DISTINCT FROM f.conv AND r.i = f.i + 1")}),
report AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
         count_if(open AND NOT blank AND NOT again) AS truncated, count_if(kind_before || kind NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv),
done AS (SELECT f.conv, f.i, {least('e', 'a')} AS b FROM f)
SELECT d.conv AS conv_id, CAST(coalesce(p.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(p.blank, 0) AS BIGINT) AS blank, CAST(coalesce(p.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(p.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(p.illegal, 0) AS BIGINT) AS illegal, CAST(d.b.c AS BIGINT) AS cost, d.b.a AS audit,
       sha256(substr(d.b.t, 2)) AS repaired_sha256
FROM done d LEFT JOIN report p ON p.conv IS NOT DISTINCT FROM d.conv WHERE d.i = coalesce(p.n, 0)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_turn_repair": _turn_repair_sql(), "op13_collocations": COLLOCATIONS_SQL}
