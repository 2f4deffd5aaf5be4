import hashlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dualcheck.llm import chat_format as C

PATH = P.path("byte_bpe_50k.json")
TEXTS = st.lists(st.sampled_from([*"<|\\>im_endstar \né😀日a", "<|im_end|>", "<|im_sep|>", "<\\|"]), max_size=20).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|im_sep|>", ""]), TEXTS), max_size=6))
def test_marks_and_masks_can_be_read_back(turns):
    text, spans = C.render(turns, "assistant")
    assert [(C.unescape(a), C.unescape(b)) for a, b in C.TURN.findall(text)] == turns
    e = C._tokenizer(PATH).encode(text, add_special_tokens=False)
    at = np.array(e.offsets, np.int64).reshape(-1, 2)
    mask = C.masked(at, spans)
    got = list(C.loss_texts(text, at[:, 0], at[:, 1], mask))
    assert got == [t for r, t in turns if r == "assistant" and t]


def slow(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_operator(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} é😀" * 3) for c in range(6) for t in range(4)]
    rows += [(50, t, "assistant", f"long {t} ") for t in range(400)] + [(7, 0, None, None), (8, None, "assistant", "x"), (8, 0, "assistant", ""), (None, 1, "assistant", "n"), (None, 0, "user", "m")]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same"), (9, 0, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.select("*", *(F.lit("!").alias(c) for c in ("id", "part", "ids", "loss")))
    for chars in (1 << 16, 40):
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.read_back(C.format_conversations(df, PATH, part_chars=chars)).collect()}
        assert got == slow(rows)
    assert C.read_back(C.format_conversations(df.limit(0), PATH)).count() == 0
