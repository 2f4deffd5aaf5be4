"""Corpus readers and converters on tiny files written to a temp folder."""
import json

import pytest

from pyspark.sql import functions as F

from dualcheck.sources import contracts as K
from dualcheck.sources import corpus as C
from dualcheck.sources import runs as R
from dualcheck.spec import FieldSpec, load_schema


def test_jsonl_corpus_and_inference(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    recs = [{"document": "a", "gold": {"date": "2018-03-05", "total": "9.00", "name": "X", "party": ["A", "B"]}},
            {"document": "b", "gold": {"date": "01/02/2019", "total": "1", "name": "Y", "party": []}}]
    p.write_text("\n".join(json.dumps(r) for r in recs) + "\n\n")
    df = C.read_jsonl_corpus(spark, str(p)).orderBy("doc_idx").collect()
    assert [r["doc_idx"] for r in df] == [0, 1]
    assert df[0]["gold"]["party"] == "A; B" and df[1]["gold"]["party"] == ""
    schema = C.infer_schema(spark, str(p))
    types = {f.name: (f.type, f.multi) for f in schema.fields}
    assert types == {"date": ("date", False), "total": ("number", False), "name": ("string", False),
                     "party": ("string", True)}


def test_many_files_keep_their_order(spark, tmp_path):
    """A small file before large ones, blank lines, and splits smaller than a file: files by path, lines as they stand."""
    d = tmp_path / "corpus"
    d.mkdir()
    sizes = {"a.jsonl": 1, "b.jsonl": 500, "c d.jsonl": 3, "e.jsonl": 200}
    want = []
    for name, n in sizes.items():
        rows = [{"document": f"{name} {i}" + "x" * (i % 50), "gold": {f"in_{name[0]}": str(i)}} for i in range(n)]
        (d / name).write_text("\n \n".join(json.dumps(r) for r in rows) + "\n\n")
        want += [r["document"] for r in rows]
    assert [f.name for f in C.infer_schema(spark, str(d)).fields] == ["in_a"]
    for size in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = C.read_jsonl_corpus(spark, str(d)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r["document"] for r in sorted(got, key=lambda r: r["doc_idx"])] == want and sorted(r["doc_idx"] for r in got) == list(range(len(want)))


def test_catalog_says_what_is_missing(spark, tmp_path):
    for name, n in (("one", 9), ("two", 2)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"document": f"{name} {i}", "gold": {}}) + "\n" for i in range(n)))
    paths = {c: str(tmp_path / f"{c}.jsonl") for c in ("one", "two", "gone")}
    got = sorted((r["corpus"], r["present"], r["records"], r["doc_idx"], r["document"]) for r in C.corpus_catalog(spark, paths).collect() if r["present"])
    assert got == [("one", True, 9, i, f"one {i}") for i in range(6)] + [("two", True, 2, i, f"two {i}") for i in range(2)]
    assert [tuple(r) for r in C.corpus_catalog(spark, paths).filter("not present").collect()] == [("gone", False, 0, None, None)]
    assert C.corpus_catalog(spark, {"gone": str(tmp_path / "no")}).count() == 1


def test_gold_key_sets(spark):
    rows = [("a", {"x": "1", "y": "2"}), ("b", {"x": "1"}), (" ", {"x": "1", "y": "2", "z": "3"}), ("c", {"y": "1", "x": ""})]
    docs = spark.createDataFrame(rows, "document string, gold map<string,string>")
    assert tuple(C.gold_keys(docs, ("x", "y")).first()) == (4, 3, 1, 1, False)
    assert C.gold_keys(docs.filter("document in ('a', 'c')"), ("y", "x")).first()["exact"]
    assert tuple(C.gold_keys(docs.limit(0), ("x",)).first()) == (0, 0, 0, 0, True)


def test_gold_values_as_text(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    gold = {"redacted": "[REDACTED] Ltd", "none": None, "list": ["A", 1], "half": 12.5, "yes": True, "n": 7}
    p.write_text("\n" + json.dumps({"document": "d", "gold": gold}) + "\n")
    row = C.read_jsonl_corpus(spark, str(p)).first()
    assert row["gold"] == {"redacted": "[REDACTED] Ltd", "none": "None", "list": "A; 1", "half": "12.5", "yes": "True", "n": "7"}


def test_bad_lines_and_empty_corpora_raise(spark, tmp_path):
    bad, empty = tmp_path / "bad.jsonl", tmp_path / "empty.jsonl"
    bad.write_text('{"document": "d", "gold": {}}\nnot json\n')
    empty.write_text("\n \n")
    with pytest.raises(Exception):
        C.read_jsonl_corpus(spark, str(bad)).collect()
    with pytest.raises(ValueError):
        C.read_jsonl_corpus(spark, str(empty))


def test_rows_are_numbered_across_partitions(spark):
    df = spark.range(1000).repartition(7).filter("id % 3 <> 0")
    assert sorted(r["doc_idx"] for r in C.numbered(df).collect()) == list(range(df.count()))


def test_schema_files(spark, tmp_path):
    p = tmp_path / "schema.json"
    p.write_text(json.dumps({"name": "s", "fields": [{"name": "a", "type": "enum", "enum": ["x", "y"]}, {"name": "b", "type": "date", "required": False, "multi": True}]}))
    found = load_schema(spark, str(p))
    assert found.fields == (FieldSpec("a", "enum", ("x", "y")), FieldSpec("b", "date", None, "", False, True))
    for fields in ([{"name": "a", "type": "enum"}], [{"name": "a", "type": "money"}]):
        p.write_text(json.dumps({"name": "s", "fields": fields}))
        with pytest.raises(ValueError):
            load_schema(spark, str(p))


def test_corpora_are_compared(spark):
    a = C.fingerprints(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string"))
    b = C.fingerprints(spark.createDataFrame([(1, "x"), (2, "z"), (3, "")], "doc_id long, text string"))
    assert C.same_corpus(a, a).first()["identical"]
    assert tuple(C.same_corpus(a, b).first()) == (2, 3, 1, 1, False)
    assert C.corpus_digest(a).first() != C.corpus_digest(b).first()


def test_box_to_text(spark, tmp_path):
    d = tmp_path / "box"
    d.mkdir()
    (d / "001.csv").write_text("1,2,3,4,5,6,7,8,ACME, SDN BHD\n1,2,3\n1,2,3,4,5,6,7,8,TOTAL 9.00\n")
    row = C.box_to_text(spark, str(d)).first()
    assert row["stem"] == "001" and row["document"] == "ACME, SDN BHD\nTOTAL 9.00"


def test_receipts_join_on_names_as_they_are(spark, tmp_path):
    """Blanks, percent signs and other letters in names; a missing box, an empty one and a missing key drop the receipt."""
    box, key = tmp_path / "box", tmp_path / "key"
    box.mkdir()
    key.mkdir()
    line = "1,2,3,4,5,6,7,8,"
    for stem in ("a b", "c%20d", "é+1", "x.y", "empty", "no key"):
        (box / f"{stem}.csv").write_text("" if stem == "empty" else f"{line}TEXT {stem}\n")
    for stem in ("a b", "c%20d", "é+1", "x.y", "empty", "no box", "no key"):
        found = {"company": stem, "date": "d", "address": "a", "total": "9.00"}
        (key / f"{stem}.json").write_text(json.dumps({k: v for k, v in found.items() if stem != "no key" or k != "total"}, indent=1))
    got = C.receipts(C.box_to_text(spark, str(box)), C.read_keys(spark, str(key), ("company", "date", "address", "total"))).collect()
    assert sorted((r["stem"], r["document"], r["gold"]["company"]) for r in got) == sorted((s, f"TEXT {s}", s) for s in ("a b", "c%20d", "é+1", "x.y"))
    R.write_corpus(C.receipts(C.box_to_text(spark, str(box)), C.read_keys(spark, str(key), ("company", "total")), ("company", "total")), str(tmp_path / "out"), ("stem",))
    again = C.read_jsonl_corpus(spark, str(tmp_path / "out")).orderBy("doc_idx").collect()
    assert [r["document"] for r in again] == ["TEXT a b", "TEXT c%20d", "TEXT x.y", "TEXT é+1"]


def test_sweep_points_are_stored(spark, tmp_path):
    points = spark.createDataFrame([("r", 0.1, 0.5, 3), ("r", 0.5, 0.75, 2)], "run_id string, threshold double, final_acc double, llm_calls long")
    for _ in range(2):  # writing again replaces
        R.write_points(points, str(tmp_path / "points"))
    assert sorted(map(tuple, R.read_points(spark, str(tmp_path / "points")).collect())) == sorted(map(tuple, points.collect()))


def test_clause_reduce(spark):
    mid = "x" * 2000 + "This Agreement shall be governed by the laws of the State." + "y" * 2000
    text = "H" * 3000 + mid + "T" * 1500
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    out = {r["doc_id"]: r["reduced"] for r in C.clause_reduce(df).collect()}
    assert out[2] == "short"
    parts = out[1].split("\n[...]\n")
    assert parts[0] == "H" * 3000 and parts[-1] == "T" * 1500 and "governed by" in parts[1]
    assert len(parts) == 3  # the two keyword windows overlap and merge
    row = {r["doc_id"]: r for r in C.clause_reduce(df).collect()}[1]
    assert row["dropped"] == len(text) - sum(map(len, parts))
    assert [text[a:b] for a, b in row["kept_spans"]] == parts
    small = C.clause_reduce(df, head_chars=10, tail_chars=5, window=20).filter("doc_id = 1").first()
    assert small["reduced"].startswith("H" * 10 + "\n") and small["dropped"] > row["dropped"]


def test_label_lines_roundtrip(spark):
    df = spark.createDataFrame([(1, "effective_date=2019-01-05 party=Acme_Inc party=Beta jurisdiction=New_York")],
                               "doc_id long, line string")
    r = C.parse_label_lines(df, ("effective_date", "jurisdiction", "term"), "party").first()
    assert (r["effective_date"], r["jurisdiction"], r["term"], r["party"]) == \
        ("2019-01-05", "New York", "", "Acme Inc; Beta")


def test_contracts_are_paired_by_line(spark, tmp_path):
    tsv, labels = tmp_path / "in.tsv", tmp_path / "expected.tsv"
    tsv.write_text('a\tb\tc\td\te\tfirst\\nline "" x\na\tb\tc\td\te\t"second ""quoted""\nwith a line end"\n')
    labels.write_text("term=2_years party=Acme_Inc party=Beta\njurisdiction=New_York\n")
    got = K.read_contracts(spark, str(tsv), str(labels), ("jurisdiction", "term"), "party").orderBy("doc_idx").collect()
    assert [r["document"] for r in got] == ['first\nline "" x', 'second "quoted"\nwith a line end']
    assert got[0]["gold"] == {"jurisdiction": "", "term": "2 years", "party": "Acme Inc; Beta"} and got[1]["gold"]["jurisdiction"] == "New York"


def tsv(rows):
    """As another writer would: quoted where there is a tab, a quote or a line end."""
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set('\t"\n') else v
    return "".join("\t".join(quoted(v) for v in r) + "\n" for r in rows)


def test_records_over_many_splits(spark, tmp_path):
    """Line ends, tabs, doubled and literal quotes in and around quoted fields, like Spark's reader of whole files and Python's."""
    texts = ["plain", "two\nlines", 'a "quoted" word', "tab\there", "", '"', '\n"\n', "x" * 300 + "\n" * 40 + '"' * 41, 'ends in quote"', "\n\n"]
    rows = [[f"k{i}", "", "b\tc" if i % 3 == 0 else "d", texts[i % len(texts)], f"{i}"] for i in range(400)]
    path = tmp_path / "in.tsv"
    path.write_text(tsv(rows))
    import csv
    want = [r[3] for r in csv.reader(path.open(), delimiter="\t")]
    assert want == [r[3] for r in rows]
    for size in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            tasks = C.file_lines(spark, str(path)).rdd.getNumPartitions()
            got = sorted(tuple(r) for r in K.quoted_records(spark, str(path), 3).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == list(enumerate(want)) and (tasks > 20 or size == "128m")
    whole = spark.read.schema("a string, b string, c string, d string, e string").option("sep", "\t").option("multiLine", "true").option("escape", '"').csv(str(path))
    assert sorted(r["d"] or "" for r in whole.collect()) == sorted(want)


def test_quotes_inside_plain_fields_and_folders(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    (d / "a.tsv").write_text('5" pipe\tx\n"open\n5"" in\n"tail "q"\ty\n')
    (d / "b.tsv").write_text('a"b"c\t"z\n"\n')
    assert sorted(tuple(r) for r in K.quoted_records(spark, str(d), 0).collect()) == [(0, '5" pipe'), (1, 'open\n5" in\ntail "q"'), (2, 'a"b"c')]
    assert [r["value"] for r in K.quoted_records(spark, str(d), 1).orderBy("place").collect()] == ["x", "y", "z\n"]


def test_short_records_and_open_quotes_raise(spark, tmp_path):
    short, open_ = tmp_path / "short.tsv", tmp_path / "open.tsv"
    short.write_text("a\tb\tc\nd\te\n")
    open_.write_text('a\tb\n"c\td\n')
    with pytest.raises(Exception, match="has 2 columns"):
        K.quoted_records(spark, str(short), 2).collect()
    with pytest.raises(ValueError, match="never closed"):
        K.quoted_records(spark, str(open_), 1)


def test_corpora_are_written_and_read_again(spark, tmp_path):
    docs = spark.createDataFrame([("a\nb", {"x": "1", "y": "[z]"}), ("c", {"x": "", "y": "é"})], "document string, gold map<string,string>")
    R.write_corpus(docs, str(tmp_path / "out"))
    got = {r["document"]: r["gold"] for r in C.read_jsonl_corpus(spark, str(tmp_path / "out")).collect()}
    assert got == {r["document"]: r["gold"] for r in docs.collect()}


def test_one_language_of_a_catalog_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from dualcheck.plans import registry

    docs = spark.range(400).selectExpr("399 - id AS doc_id", "concat('text ', 399 - id) AS text", "if(id % 100 = 7, 'de', 'en') AS lang", "'web' AS source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(registry, "scratch_path", lambda _, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = registry.q_corpus_catalog(spark, str(tmp_path)).filter("corpus = 'en'").orderBy("doc_idx").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "corpora" / "lang=en").glob("*.json"))) > 1
    want = spark.range(400).selectExpr("id", "sha2(concat('text ', id), 256) AS h").filter("id < 6").orderBy("id").collect()
    assert [(r["doc_idx"], r["document_sha"], r["records"]) for r in found] == [(w["id"], w["h"], 396) for w in want]
