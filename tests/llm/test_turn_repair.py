import hashlib
import re
from binascii import crc32
from itertools import product

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dualcheck.llm import queries
from dualcheck.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string"
GOAL = re.compile("(s?(ua)+)?")
INITIAL = "sua?"


def scripts(rows, most=3):
    """All edits of rows (class, cut off, must go) with at most so many rows inserted at a place: (cost, audit, roles)."""
    places = [["".join(p) for n in range(most + 1) for p in product("ua", repeat=n)]] * (len(rows) + 1)
    choices = [[("D", 3, "")] + ([] if gone else [("K", cut, INITIAL[kind]), ("R", 2 + cut, "u"), ("R", 2 + cut, "a")]) for kind, cut, gone in rows]
    for put in product(*places):
        for chosen in product(*choices):
            roles = put[0] + "".join(c[2] + p for c, p in zip(chosen, put[1:]))
            if GOAL.fullmatch(roles):
                yield sum(c[1] for c in chosen) + 2 * sum(map(len, put)), "I" * len(put[0]) + "".join(c[0] + "I" * len(p) for c, p in zip(chosen, put[1:])), roles


@pytest.mark.parametrize("n", [0, 1, 2])
def test_all_scripts_of_short_conversations(n):
    kinds = [(0, 0, True)] + [(k, c, False) for k in range(4) for c in (0, 1)]
    for rows in product(kinds, repeat=n):
        symbols = bytes(0 if gone else 1 + 2 * k + c for k, c, gone in rows)
        assert T.tables().repair(symbols) == min(scripts(rows))[:2]


def plain(symbols):
    """The least (cost, audit) by going from row to row with a string for each state."""
    def insert(f):
        for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if f[a]:
                new = (f[a][0] + 2, f[a][1] + "I")
                f[b] = min(f[b], new) if f[b] else new
        return f
    f = insert([(0, ""), None, None, None])
    for x in symbols:
        g = [None] * 4
        for s in range(4):
            for e, cost, after in T.edits(x, s) if f[s] else ():
                new = (f[s][0] + cost, f[s][1] + e)
                g[after] = min(g[after], new) if g[after] else new
        f = insert(g)
    return min(x for x in (f[0], f[3]) if x)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, T.SYMBOLS - 1), max_size=40), st.integers(1, 4))
def test_blocks_like_single_rows(symbols, block):
    t = _blocks(block)
    assert t.repair(bytes(symbols)) == plain(symbols)


def _blocks(block, made={}):
    return made.setdefault(block, T.Tables(block))


def test_few_vectors():
    t = T.tables()
    assert len(t.vectors) < 100 and all(min(v) == 0 and max(v) <= 4 for v in t.vectors) and len(t.steps[0]) == T.SYMBOLS ** T.BLOCK


def test_many_rows():
    symbols = bytes([3, 5] * 100_000 + [0, 7, 1] * 50_001)
    cost, audit = T.tables().repair(symbols)
    assert audit.startswith("KKKK") and len(audit) >= len(symbols) and cost >= 150_003


def slow(rows):
    """{conv: report} of (conv, turn, role, text) rows by the task's words."""
    out = {}
    for conv in {r[0] for r in rows}:
        there = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            there += [(turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.sha256(text.encode()).hexdigest(), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        there.sort()
        turns = [t for known, t, *_ in there if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen, symbols = [0, 0, 0], set(), []
        for _, _, role, _, text in there:
            last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            symbols.append(0 if fault in (0, 1) else 1 + 2 * (INITIAL.find(role[:1]) if role[:1] and role[0] in "sua" else 3) + (fault == 2))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(there, there[1:]))
        cost, audit = plain(symbols)
        lines, i, roles = [], 0, ""
        for e in audit:
            due = "assistant" if roles.endswith("u") else "user"
            row = there[i] if e != "I" else None
            i += e != "I"
            if e != "D":
                role = row[2] if e == "K" else due
                lines.append(f"{role}:{row[4] if row else ''}")
                roles += role[0]
        assert i == len(there) and GOAL.fullmatch(roles)
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def awkward():
    texts = ["Done.", "Done.", "no end", "", " \n", "ok!", "Why? ", "Why? \t", None, "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "assistant"]
    rows = [(c, t, roles[(c * 3 + t * 7) % 10 if t % 3 else t % 2], texts[(c + t * t) % 10]) for c in range(60) for t in range(c % 13)]
    rows += [(100, None, "user", "Hi."), (100, None, "assistant", "Hi."), (100, 3, "user", "Hi."), (None, 0, "user", "A."), (None, 1, "assistant", "B.")]
    rows += [(101, 5, "assistant", "Same."), (101, 5, "assistant", "Same."), (101, 5, "user", "Same."), (102, 9, "user", "x.")]
    rows += [(103, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(300)] + [(104, t, "user", "ok.") for t in range(100)]
    rows += [(c, 0, "user", "Alone.") for c in range(200, 260)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5).select("*", *(F.lit("!").alias(c) for c in ("id", "row", "copies", "digest", "cost", "audit", "seen")))


def test_operator(spark, frame):
    got = {r[0]: tuple(r)[1:] for r in T.repair_report(T.damaged(frame)).collect()}
    assert got == slow(awkward())
    assert any(not a for *_, a, _ in got.values())  # a conversation that lost all its rows
    empty = T.damaged(frame.limit(0))
    assert T.repair_report(empty).count() == 0 and T.repaired(empty).count() == 0


def test_rows_after_repair(frame):
    lines = {}
    for r in sorted(T.repaired(T.damaged(frame)).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["place"])):
        found = lines.setdefault(r["conv_id"], [])
        assert r["place"] == len(found) and r["edit"] in "KRI"
        found.append(f"{r['role']}:{r['text']}")
    for conv, (*_, digest) in slow(awkward()).items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == digest


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r)[1:] for r in queries.op11_turn_repair(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == slow(rows)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert {r[0]: r[1:] for r in db.execute(queries.oracle_sql()["op11_turn_repair"]).fetchall()} == got


def test_sql_on_awkward_rows(spark):
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", [r for r in awkward() if r[2] != ""])
    got = {r[0]: r[1:] for r in db.execute(queries.oracle_sql()["op11_turn_repair"]).fetchall()}
    assert got == slow([r for r in awkward() if r[2] != ""])
