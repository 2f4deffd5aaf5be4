"""Answers survive failures, and only what has no answer is asked again."""
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from dualcheck.operators import acquire as A
from dualcheck.spec import FieldSpec, Schema

SCHEMA = Schema("consignment", tuple(FieldSpec(f"f{i}", "string") for i in range(8)))


@pytest.fixture
def study(spark, tmp_path):
    class Client:
        """Answers with the field it was asked for, counts calls as files, and raises for some fields."""

        def __init__(self, folder, broken=(), slow=(), lost=()):
            self.folder, self.broken, self.slow, self.lost = folder, broken, slow, lost

        def generate(self, prompt, force_json=False):
            field = re.search("FIELD: (.*)", prompt)[1]
            open(f"{self.folder}/{field}-{uuid.uuid4().hex}", "w").close()
            if field in self.broken:
                raise ValueError("no answer")
            if field in self.slow:
                raise TimeoutError("late")
            if field in self.lost:
                os._exit(1)
            return field

    calls = tmp_path / "calls"
    calls.mkdir()

    def requests(document="the page", n=8):
        docs = spark.createDataFrame([(1, document)], "doc_id long, document string")
        work = spark.createDataFrame([("r", 1, i, f.name) for i, f in enumerate(SCHEMA.fields[:n])], "run_id string, doc_id long, ord int, field string")
        return A.arbiter_requests(work, docs, SCHEMA)

    def asked():
        return sorted(f.split("-")[0] for f in os.listdir(calls))
    return requests, (lambda **kw: (lambda folder=str(calls): Client(folder, **kw))), str(tmp_path / "ledger"), asked


def test_one_failure_leaves_all_other_answers(spark, study):
    requests, client, store, asked = study
    got = A.acquire(requests(), client(slow=("f3",), broken=("f5",)), store).collect()
    assert sorted(r["raw"] for r in got) == ["f0", "f1", "f2", "f4", "f6", "f7"] and asked().count("f3") == 2 and asked().count("f5") == 1
    failed = {r["field"]: (r["raw"], r["error"], r["tries"]) for r in A.ledger(spark, store).filter("error is not null").collect()}
    assert failed == {"f3": (None, "TimeoutError: late", 2), "f5": (None, "ValueError: no answer", 1)}
    before = len(asked())
    got = A.acquire(requests(), client(), store)
    assert sorted(r["raw"] for r in got.collect()) == [f"f{i}" for i in range(8)] and len(asked()) == before + 2
    assert all(r["prompt"].endswith("the page\n") for r in got.collect())
    assert A.ask(requests(), client(), store) == 0 and len(asked()) == before + 2
    last = {r["field"]: (r["raw"], r["tries"], r["calls"]) for r in A.latest(A.ledger(spark, store)).collect()}
    assert last["f3"] == ("f3", 3, 2) and last["f5"] == ("f5", 2, 2) and last["f0"] == ("f0", 1, 1)


def test_other_words_are_another_request(spark, study):
    requests, client, store, asked = study
    A.ask(requests("the page", 2), client(), store)
    got = A.acquire(requests("another page", 2), client(), store).collect()
    assert len(asked()) == 4 and all(r["prompt"].endswith("another page\n") for r in got) and len(got) == 2
    assert A.acquire(requests("the page", 2), client(), store).count() == 2 and len(asked()) == 4
    assert A.acquire(requests("a third page", 2), client(broken=("f0", "f1")), store).count() == 0


def test_waves_are_committed_one_by_one(spark, study):
    """Whatever ends the study, the waves before stay: here a worker that dies, which fails its job."""
    requests, client, store, asked = study
    with pytest.raises(Exception):
        A.ask(requests(), client(lost=("f6",)), store, wave=1)
    kept = {r["field"] for r in A.ledger(spark, store).collect()}
    assert kept < {f.name for f in SCHEMA.fields} and "f6" not in kept
    before = {f: asked().count(f) for f in kept}
    assert sorted(r["raw"] for r in A.acquire(requests(), client(), store, wave=3).collect()) == [f"f{i}" for i in range(8)]
    assert all(asked().count(f) == n for f, n in before.items())


def test_nothing_to_ask_and_no_ledger(spark, study):
    requests, client, store, asked = study
    assert A.ledger(spark, store).count() == 0 and A.latest(A.ledger(spark, store)).count() == 0
    assert A.acquire(requests().limit(0), client(), store).count() == 0 and asked() == []
    with pytest.raises(ValueError):
        A.ask(requests(), client(), store, attempts=0)


def test_answers_become_extractions(spark):
    rows = [("r", 1, "constrained", "", '{"a": 1}'), ("r", 1, "unconstrained", "", "a: 1"), ("r", 2, "constrained", "", "{}"), ("r", 1, "arbiter", "a", "x")]
    df = spark.createDataFrame(rows, "run_id string, doc_id long, path string, field string, raw string")
    assert sorted(map(tuple, A.extractions_from_responses(df).collect())) == [("r", 1, '{"a": 1}', "a: 1"), ("r", 2, "{}", None)]
    assert A.acquire_recorded(df.select("run_id", "doc_id", "field"), df.filter(F.col("path") == "arbiter").select("run_id", "doc_id", "field", "raw")).count() == 1
