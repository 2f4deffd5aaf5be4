"""Driver contract: entry runs, every query outside the llm folder has an
oracle, and the flagship report matches its DuckDB oracle."""
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from dualcheck.plans.registry import _inputs
from dualcheck.session import METHOD_LIMIT_KEY, ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["docs"] > 0


def test_oracle_coverage():
    missing = {q for q in set(E.queries()) - set(E.oracle_sql()) if q != "pipeline" and not q.startswith("op")}
    assert not missing


def test_audit_methods_are_small_enough_to_be_compiled(spark):
    """HotSpot interprets methods of more than 8,000 bytes; other queries of the session keep its own setting."""
    own = spark.conf.get(METHOD_LIMIT_KEY)
    spark.conf.unset(METHOD_LIMIT_KEY)
    _inputs(spark, SF)
    assert spark.conf.get(METHOD_LIMIT_KEY) == "8000"
    E.queries()["corpus_shape"](spark, SF)
    assert spark.conf.get(METHOD_LIMIT_KEY) == "65535"
    spark.conf.set(METHOD_LIMIT_KEY, own)


def test_a_cluster_needs_a_shared_folder():
    class Settings:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://driver:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Settings(), Context()
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_library_stands_without_the_llm_folder():
    """No module outside of it imports the optional subpackage."""
    root = Path(E.__file__).parent
    for f in (root / "dualcheck").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in re.findall(r"(?:from|import) [\w.]*", f.read_text()).__str__(), f


def test_run_report_matches_oracle(spark):
    got = E.queries()["run_report"](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(E.oracle_sql()["run_report"]).df()
    for c in ("docs", "final_acc", "constrained_acc", "flag_precision", "flag_recall", "llm_calls", "ungrounded"):
        assert float(got[c][0]) == float(want[c][0]), c
