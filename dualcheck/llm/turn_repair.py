"""Repair of conversations whose turns do not alternate, by Four-Russians tables.

The roles of a sound conversation read ``(s?(ua)+)?``: perhaps a system row, then
user and assistant in turn, or nothing. Rows are kept, given another role or
deleted, and empty rows inserted, at the least cost. What the rest of a
conversation costs depends on the state of that pattern only: a vector of four
costs, of which any two differ by a few units. Less its least entry, a vector is
one of a few, so the step over any block of ``BLOCK`` symbols is a table: from
the vector behind the block, the one before it and what is added to all entries.
A conversation is read from its end, a block at a time. The edits are then
traced from its start: a block's vectors are looked up once more row by row,
from its end backward, and the least edit that is still cheapest is taken, which
gives the cheapest edits that come first in ASCII order.

A symbol says what class of role a row has, whether it is cut off and whether it
must go. Only symbols are gathered, a byte for each row of a conversation; texts
stream by once the edits are known.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import with_id, written

#: Symbols of a block.
BLOCK = 4
#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant row leads to, which is the only one of both that may come next.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Costs of the edits.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: Classes of roles by their first letters, other ones last.
CLASSES = "sua"
#: Symbol 0 must go; 1 + 2 * class + cut off for all others.
SYMBOLS = 1 + 2 * (len(CLASSES) + 1)
#: What blanks are.
BLANK = r"\x20\x09-\x0D"


def symbol(role: str, cut_off: bool, gone: bool) -> int:
    at = CLASSES.find(role[0]) if role else -1
    return 0 if gone else 1 + 2 * (at if at >= 0 else len(CLASSES)) + cut_off


def kept_state(state: int, kind: int) -> int | None:
    """Where a row of a class leads to as it is; None if it can't stand here."""
    if kind == 0:
        return SYSTEM if state == EMPTY else None
    return NEXT[state] if kind < len(CLASSES) and NEXT[state] == kind + 1 else None


def edits(x: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after it) of what can be done with a row, in ASCII order."""
    out = [("D", DELETE, state)]
    if x:
        kind, cut_off = divmod(x - 1, 2)
        if (after := kept_state(state, kind)) is not None:
            out.append(("K", cut_off * CUT_OFF, after))
        out.append(("R", REROLE + cut_off * CUT_OFF, NEXT[state]))
    return out


def before(x: int, rest: tuple[int, ...]) -> tuple[int, ...]:
    """The costs before a row from those behind it, with rows inserted where that is cheaper."""
    raw = [min(cost + rest[after] for _, cost, after in edits(x, s)) for s in range(4)]
    return inserted(raw)


def inserted(raw: list[int]) -> tuple[int, ...]:
    user, assistant = min(raw[USER], raw[ASSISTANT] + INSERT), min(raw[ASSISTANT], raw[USER] + INSERT)
    return min(raw[EMPTY], user + INSERT), min(raw[SYSTEM], user + INSERT), user, assistant


class Tables:
    """All vectors that can occur, less their least entry, and the steps over single symbols and whole blocks."""

    def __init__(self, block: int = BLOCK):
        never = 1 << 20
        end = inserted([0, never, never, 0])
        self.block = block
        self.vectors = [tuple(c - min(end) for c in end)]
        number = {self.vectors[0]: 0}
        step, more = [], []
        for v in self.vectors:  # grows until no new one comes up
            row = [before(x, v) for x in range(SYMBOLS)]
            for w in (tuple(c - min(w) for c in w) for w in row):
                if w not in number:
                    number[w] = len(self.vectors)
                    self.vectors.append(w)
            step.append([number[tuple(c - min(w) for c in w)] for w in row])
            more.append([min(w) for w in row])
        self.step, self.more = step, more
        one, added = np.array(step, np.int32), np.array(more, np.int32)
        many, total = one, added
        for _ in range(block - 1):  # a symbol in front of shorter blocks
            total = np.concatenate([total + added[many, x] for x in range(SYMBOLS)], axis=1)
            many = np.concatenate([one[many, x] for x in range(SYMBOLS)], axis=1)
        self.steps, self.totals = many.tolist(), total.tolist()
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def trace(self, symbols: bytes, behind: int, state: int) -> tuple[str, int]:
        """The edits of a few rows before a vector, from a state on, and the state after them."""
        seen = [behind]
        for x in reversed(symbols):
            seen.append(self.step[seen[-1]][x])
        out = []
        for x, here, after in zip(symbols, seen[:0:-1], seen[-2::-1]):
            added, now, rest = self.more[after][x], self.vectors[here], self.vectors[after]
            while True:
                cheapest = [(e, s) for e, cost, s in edits(x, state) if cost + rest[s] == now[state] + added]
                if now[NEXT[state]] + INSERT == now[state] and not (cheapest and cheapest[0][0] < "I"):
                    out.append("I")
                    state = NEXT[state]
                    continue
                out.append(cheapest[0][0])
                state = cheapest[0][1]
                break
        return "".join(out), state

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost of a conversation's symbols and its first cheapest edits."""
        odd = len(symbols) % self.block
        codes = (np.frombuffer(symbols, np.uint8, offset=odd).reshape(-1, self.block).astype(np.int64) @ self.weights).tolist()
        behind, v, cost = [0] * len(codes), 0, 0
        for i in range(len(codes) - 1, -1, -1):
            behind[i] = v
            cost += self.totals[v][codes[i]]
            v = self.steps[v][codes[i]]
        first = v
        for x in reversed(symbols[:odd]):
            cost += self.more[v][x]
            v = self.step[v][x]
        text, state = self.trace(symbols[:odd], first, EMPTY)
        out = [text]
        for i, code in enumerate(codes):
            key = behind[i], code, state
            if key not in self.traced:
                at = odd + i * self.block
                self.traced[key] = self.trace(symbols[at:at + self.block], behind[i], state)
            text, state = self.traced[key]
            out.append(text)
        while state in (SYSTEM, USER):
            out.append("I")
            state = NEXT[state]
        return cost + self.vectors[v][EMPTY], "".join(out)


@cache
def tables() -> Tables:
    return Tables()


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by a hash of conversation and turn: id, turn, role, text and how often the row is there.

    Of twenty, 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away,
    3 repeats it and 4 makes its role user. A null id, turn, role or text reads
    as one blank; the turn stays null for the order.
    """
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said(conv_col), said(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said(text_col), ".!?", "")).otherwise(said(text_col))
    return rows.select(F.col(f"`{conv_col}`").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(said(role_col)).alias("role"),
                       text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with a digest of the text, which orders ties and tells equal texts."""
    return rows.withColumn("digest", F.sha2("text", 256))


ORDER = ("id", "turn", "role", "digest")


def judged(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of prepared rows.

    Where a text stood before is asked of its group's least turn: groups are
    pre-aggregated, and only those that repeat are joined to their rows.
    """
    there = rows.filter("copies > 0").groupBy("id", "role", "digest").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("least"))
    again = written(there.filter("n > 1").drop("n"), "repeated-turns").withColumnRenamed("id", "other").withColumnRenamed("role", "r").withColumnRenamed("digest", "d")
    narrow = rows.select("id", "turn", "role", "digest", "copies", (~F.col("text").rlike(f"[^{BLANK}]")).alias("blank"),
                         (~F.col("text").rlike(rf"[.!?][{BLANK}]*+\z")).alias("cut_off"))
    seen = F.col("turn").isNotNull() & (F.col("no_turn") | (F.col("turn") > F.col("least")))
    marked = (narrow.join(again, F.col("id").eqNullSafe(F.col("other")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
              .select("id", "turn", "role", "digest", "copies", "blank", "cut_off", F.coalesce(seen, F.lit(False)).alias("seen")))
    dealt = marked.repartition("id").sortWithinPartitions(*ORDER)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = StructType([StructField("id", rows.schema["id"].dataType), *(StructField(n, LongType()) for n in names), StructField("audit", StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, kind, done = tables(), None, []
        conv, now = object(), None

        def finish() -> None:
            symbols, turns, faults, illegal = now[0], now[1], now[2], now[3]
            cost, audit = t.repair(bytes(symbols))
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            done.append((conv, gaps, *faults, illegal, cost, audit))

        def flush() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], schema.fieldNames())
            done.clear()
            return out
        for b in batches:
            kind = b.schema.field(0).type
            for i, turn, role, digest, copies, blank, cut_off, seen in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or i != conv:
                    if now is not None:
                        finish()
                    # symbols; least, last and number of turns; blank, repeated and cut off rows; illegal pairs; the row before
                    conv, now = i, [bytearray(), [None, None, 0], [0, 0, 0], 0, None]
                symbols, turns, faults = now[:3]
                for _ in range(copies):
                    row = (turn, role, digest)
                    if turn is not None and turn != turns[1]:
                        turns[0] = turn if turns[0] is None else turns[0]
                        turns[1], turns[2] = turn, turns[2] + 1
                    repeated = seen or row == now[4]
                    if blank or repeated or cut_off:
                        faults[0 if blank else 1 if repeated else 2] += 1
                    if now[4] is not None and now[4][1][:1] + role[:1] not in ("su", "ua", "au"):
                        now[3] += 1
                    symbols.append(symbol(role, cut_off, blank or repeated))
                    now[4] = row
            if done:
                yield flush()
        if now is not None:
            finish()
            yield flush()
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _replayed(rows: DataFrame, verdicts: DataFrame, id_col: str) -> DataFrame:
    """Each conversation's verdict, then its rows in order; a conversation is in one task, which need not hold it."""
    numbers = [c for c in verdicts.columns if c not in (id_col, "audit")]
    none = [F.lit(None).cast("long").alias(c) for c in numbers]
    heads = verdicts.select(F.col(f"`{id_col}`").alias("id"), F.lit(0).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
                            F.col("audit").alias("text"), F.lit(0).alias("copies"), *numbers)
    lines = rows.filter("copies > 0").select("id", F.lit(1).alias("row"), "turn", "role", "digest", "text", "copies", *none)
    return heads.unionByName(lines).repartition("id").sortWithinPartitions("id", "row", "turn", "role", "digest")


class _Replay:
    """The edits of a conversation, applied to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield NAMES[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of the rows that stand for one; none if it goes."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if role[0] == "s" else NEXT[self.state]
            yield role, text, edit
        elif edit == "R":
            self.state = NEXT[self.state]
            yield NAMES[self.state], text, edit


def repaired(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, place, role, text, edit): the rows of all conversations after repair, in order from place 0.

    ``rows`` has id, turn, role, text and copies, as ``damaged`` gives; edit is
    K, R or I. A conversation that loses all its rows has none here.
    """
    rows = _prepared(rows)
    verdicts = written(judged(rows, id_col), "repairs")
    schema = StructType([StructField(id_col, rows.schema["id"].dataType), StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType()),
                         StructField("edit", StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, conv, kind = None, 0, None, None

        def batch(lines: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines), [kind, pa.int64(), *[pa.string()] * 3])], schema.fieldNames())
        for b in batches:
            kind, out = b.schema.field(0).type, []
            for i, row, _, role, _, text, copies in zip(*(c.to_pylist() for c in b.columns[:7])):
                new = [] if row else list(now.inserts()) if now else []
                for _ in range(copies):
                    new += now.row(role, text)
                out += [(conv, place + k, *x) for k, x in enumerate(new)]
                place += len(new)
                if not row:
                    now, place, conv = _Replay(text), 0, i
            if out:
                yield batch(out)
        if now and (new := list(now.inserts())):
            yield batch([(conv, place + k, *x) for k, x in enumerate(new)])
    return _replayed(rows, verdicts, id_col).mapInArrow(run, schema)


def repair_report(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``rows`` has id, turn, role, text and copies, as ``damaged`` gives; a row
    of no copies is not there, but its conversation is. Rows are ordered by turn
    (nulls first), then role, then the SHA-256 of the text, so repeated rows are
    neighbours. gaps are turns without a row between the least and the last;
    blank, duplicate and truncated count each row once, by its first fault;
    illegal counts neighbours whose roles don't begin with su, ua or au. audit
    has the first letters of the cheapest edits (Keep, Rerole, Delete, Insert),
    the least in ASCII order of several. An empty role is of no class, like any
    other that does not begin with s, u or a: it is given a role or goes. Rows
    with a null id are one conversation; one without rows has zeros, no edits
    and the hash of nothing; an empty table gives an empty result. The hash
    needs a conversation's lines in order, so they stream through one task.
    """
    rows = _prepared(rows)
    verdicts = written(judged(rows, id_col), "repairs")
    schema = with_id(verdicts, id_col, *((f.name, f.dataType) for f in verdicts.schema.fields if f.name != id_col), ("repaired_sha256", StringType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now, hashed, empty = None, None, None, True

        def add(lines: Iterable[tuple[str, str, str]]) -> None:
            nonlocal empty
            for role, text, _ in lines:
                hashed.update((f"{role}:{text}" if empty else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
                empty = False

        def finish() -> tuple:
            add(now.inserts())
            return (*head, now.audit, hashed.hexdigest())

        def batch(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), [kind, *[pa.int64()] * 6, *[pa.string()] * 2])], schema.fieldNames())
        for b in batches:
            kind, done = b.schema.field(0).type, []
            for i, row, _, role, _, text, copies, *numbers in zip(*(c.to_pylist() for c in b.columns)):
                if not row:
                    if now:
                        done.append(finish())
                    head, now, hashed, empty = (i, *numbers), _Replay(text), hashlib.sha256(), True
                for _ in range(copies):
                    add(now.row(role, text))
            if done:
                yield batch(done)
        if now:
            yield batch([finish()])
    return _replayed(rows, verdicts, id_col).mapInArrow(run, schema)
