import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dualcheck.llm import suffix_dedup
from dualcheck.llm.column_bwt import repeated_windows

from .conftest import SCHEMA, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", max_size=14), st.integers(-4, 4)), max_size=8), st.integers(1, 6))
def test_columns_against_counted_windows(strings, n):
    strings = [(s.encode(), c) for s, c in strings]
    times = Counter((c + i, s[i:i + n]) for s, c in strings for i in range(len(s) - n + 1))
    got = repeated_windows([s for s, _ in strings], [c for _, c in strings], n)
    assert [x.tolist() for x in got] == [[times[c + i, s[i:i + n]] > 1 for i in range(len(s) - n + 1)] for s, c in strings]


def slow(texts: list[str | None], n: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[i:i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if times[t[i:i + n]] > 1:
                gone[i:i + n] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_whole_operator(clashing, rows):
    want = sorted(((r[0], *x) for r, x in zip(rows, slow([r[1] for r in rows], 200))), key=repr)
    got = sorted((tuple(r) for r in suffix_dedup.removed(clashing).collect()), key=repr)
    assert got == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("hot", [1, 4096])
def test_short_windows_and_hot_anchors(spark, hot):
    r = random.Random(4)
    shared = words(1, 30)
    texts = [words(i, 4)[:r.randint(0, 30)] + shared[r.randint(0, 30):r.randint(40, 150)] + words(i + 99, 5) for i in range(60)] + ["ab" * 60, "x" * 40, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(tuple(r) for r in suffix_dedup.removed(docs, length=40, gram=12, hot_strings=hot).collect())
    assert got == [(i, *x) for i, x in enumerate(slow(texts, 40))]


def test_no_group_of_a_common_passage_is_gathered_whole(spark, monkeypatch):
    sizes, plain = [], suffix_dedup._sorted_windows

    def watched(strings, length):
        sizes.extend(r["count"] for r in strings.groupBy("group").count().collect())
        return plain(strings, length)
    monkeypatch.setattr(suffix_dedup, "_sorted_windows", watched)
    r = random.Random(9)
    junk = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60))
    shared = junk()[:50]
    texts = [junk() + shared + junk() for _ in range(300)] + [junk()[:20] + shared[:36] + "tail" + junk()] * 2
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(tuple(r) for r in suffix_dedup.removed(docs, length=40, gram=12, hot_strings=100).collect())
    assert got == [(i, *x) for i, x in enumerate(slow(texts, 40))]
    assert max(sizes, default=0) <= 100


def test_periodic_stretches_are_few_rows(spark):
    r = random.Random(2)
    letters = lambda k: "".join(r.choices("abcdefghij", k=k))
    period = letters(37)
    texts = ["x" * 20_000, "ab" * 4_000 + letters(90) + "ab" * 120, letters(300) + period * 150 + letters(300), period[:11] + period * 7 + "x" * 500, "x" * 200, letters(250)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    keyed = docs.selectExpr("doc_id as id", "doc_id as key", "text")
    assert suffix_dedup.runs(keyed, 200, 64).filter("id = 0").count() == 1
    assert suffix_dedup.runs(keyed, 200, 64).count() < 300
    got = sorted(tuple(x) for x in suffix_dedup.removed(docs).collect())
    assert got == [(i, *x) for i, x in enumerate(slow(texts, 200))]


def test_one_character_two_hundred_thousand_times(spark):
    docs = spark.createDataFrame([(1, "x" * 200_000, "en", "s", 0), (2, "y" * 200, "en", "s", 0)], SCHEMA)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in suffix_dedup.removed(docs).collect()}
    assert got == {1: (200_000, 200_000, 1), 2: (200, 0, 0)}


def test_long_texts_in_chunks(monkeypatch):
    text = words(3, 400).encode()
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchored(text))]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.anchored(text))]
    spread = lambda x: np.repeat(x[0], x[2]) + np.repeat(x[1] + x[3], x[2])
    assert (spread(whole) == spread(parts)).all() and parts[2].sum() == len(text) - 199


def test_texts_without_repeats(clashing, rows, no_docs):
    got = suffix_dedup.without_repeats(clashing)
    assert got.columns == clashing.columns
    want = slow([r[1] for r in rows], 200)
    kept = {(r[0], r[1] if x[1] == 0 else None) for r, x in zip(rows, want)}
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["doc_id"], r["text"]) in kept or (r["doc_id"], None) in kept
    assert suffix_dedup.without_repeats(no_docs).count() == 0 and suffix_dedup.removed(no_docs).count() == 0
