"""Chat formatting with offset-aligned loss masks.

A conversation is rendered by a template that marks each turn, and encoded once
with offsets. The spans of the assistant's texts and the spans of the tokens are
both sorted; binary search gives the tokens that lie in a text, which are those
that bear loss. The marks are tokens of their own, so no token lies across the
border of a text. Marks inside a role or a text are escaped: a ``<``, any
backslashes and a ``|`` get one more backslash, which can be taken back.

Rows are dealt by ranges of conversation and turn, so a long conversation spreads
over many tasks. It is rendered and encoded in parts of whole turns; as marks are
tokens of their own, parts encode as the whole would.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType

from .common import with_id

START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)
#: Code points after which a part ends, at the end of a turn.
PART_CHARS = 1 << 16


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str) -> tuple[str, np.ndarray]:
    """The formatted turns and the sorted spans of the texts of ``loss_role``."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{BETWEEN}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def masked(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which token spans lie inside one of the sorted turn spans."""
    if not len(spans):
        return np.zeros(len(tokens), bool)
    turn = np.searchsorted(spans[:, 0], tokens[:, 0], "right") - 1
    return (turn >= 0) & (tokens[:, 1] <= spans[turn, 1]) & (tokens[:, 0] < tokens[:, 1])


@cache
def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors
    found = Tokenizer.from_file(path)
    found.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (START, BETWEEN, END)])
    found.post_processor = processors.ByteLevel(trim_offsets=False)
    return found


def format_conversations(rows: DataFrame, path: str, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted parts of conversations: id, part, n_turns, formatted, ids, starts, ends and loss.

    ``part`` orders the parts of a conversation. ids, starts and ends hold its
    tokens and their spans in code points of ``formatted``; loss says which bear
    loss. Turns are ordered by turn (nulls first), then role, then text, so
    repeated rows stay and ties have one order. A null role or text counts as
    empty; rows with a null id are one conversation. An empty table gives an
    empty result.
    """
    picked = rows.select(F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = picked.repartitionByRange(parts, "id", "turn", "role").sortWithinPartitions("id", "turn", "role", "text")
    schema = with_id(rows, conv_col, ("part", LongType()), ("n_turns", LongType()), ("formatted", StringType()), ("ids", ArrayType(IntegerType())),
                     ("starts", ArrayType(IntegerType())), ("ends", ArrayType(IntegerType())), ("loss", ArrayType(BooleanType())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        part = TaskContext.get().partitionId() << 33
        kind = None
        waiting: list[tuple[object, list[tuple[str, str]]]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal part
            if not waiting:
                return
            texts = [render(turns, loss_role) for _, turns in waiting]
            cols: list[list] = [[] for _ in range(8)]
            for (conv, turns), (text, spans), e in zip(waiting, texts, tokenizer.encode_batch([t for t, _ in texts], add_special_tokens=False)):
                at = np.array(e.offsets, np.int32).reshape(-1, 2)
                for col, v in zip(cols, (conv, part, len(turns), text, e.ids, at[:, 0], at[:, 1], masked(at, spans))):
                    col.append(v)
                part += 1
            waiting.clear()
            kinds = [kind, pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], schema.fieldNames())
        size = total = 0
        for b in batches:
            kind = b.schema.field(0).type
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if not waiting or waiting[-1][0] != conv or size >= part_chars:
                    if total >= 4 * part_chars:
                        yield from emit()
                        total = 0
                    waiting.append((conv, []))
                    size = 0
                waiting[-1][1].append((role, text))
                size += len(text) + len(role)
                total += len(text) + len(role)
        yield from emit()
    return dealt.mapInArrow(run, schema)


def loss_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> Iterator[str]:
    """The texts under the mask, unescaped: tokens that touch or overlap are one stretch."""
    a, b = starts[loss], ends[loss]
    if len(a):
        new = np.concatenate([[True], a[1:] > np.maximum.accumulate(b)[:-1]])
        at = np.flatnonzero(new)
        for lo, hi in zip(a[at].tolist(), np.maximum.reduceat(b, at).tolist()):
            yield unescape(formatted[lo:hi])


def read_back(parts: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what ``format_conversations`` returned.

    The digests need a conversation's parts in order, so those of one
    conversation stream through one task, which holds a batch of them at a time.
    """
    ordered = (parts.select(F.col(id_col).alias("id"), "part", "formatted", "starts", "ends", "loss")
               .repartition("id").sortWithinPartitions("id", "part"))
    schema = with_id(parts, id_col, ("n_turns", LongType()), ("turns_sha256", StringType()), ("loss_chars", LongType()),
                     ("loss_sha256", StringType()), ("formatted_chars", LongType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None
        done: list[tuple] = []

        def result() -> tuple:
            conv, turns, all_turns, chars, all_loss, size = now
            return conv, turns, all_turns.hexdigest(), chars, all_loss.hexdigest(), size

        def flush() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], schema.fieldNames())
            done.clear()
            return out
        for b in batches:
            kind = b.schema.field(0).type
            for i in range(b.num_rows):
                conv, text = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                starts, ends, loss = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (3, 4, 5))
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(result())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in TURN.findall(text):
                    now[1] += 1
                    now[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                for x in loss_texts(text, starts, ends, loss):
                    now[3] += len(x)
                    now[4].update(x.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if done:
                yield flush()
        if now is not None:
            done.append(result())
            yield flush()
    return ordered.mapInArrow(run, schema)
