import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dualcheck.llm import collocations as C
from dualcheck.llm import queries
from dualcheck.llm.quotient_filter import Filter, Keys


def slow(rows, least=10, top=2000, covered=50):
    """(lang, text) rows by plain counting."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept, inside = [], defaultdict(int)
        for q, b in found.items():
            for p in (q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q)):
                inside[p] = max(inside[p], b)
        for p, a in found.items():
            if p in inside and 100 * inside[p] >= covered * a:
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 17), (2, 32), (3, 2), (3, 21), (3, 22), (3, 32)])
def test_filters_lose_nothing(n, bits):
    r = np.random.default_rng(bits)
    keys = Keys(n, bits)
    ids = [r.integers(0, min(1 << bits, 9 if seed else 1 << bits), 3000).astype(np.uint64) for seed in range(n)]
    want = Counter(zip(*(x.tolist() for x in ids)))
    left, right = keys.permuted(ids)
    assert [x.tolist() for x in keys.inverted(left, right)] == [x.tolist() for x in ids]
    assert all(int(x.max()) < 1 << w for x, w in zip((left, right), keys.widths))
    parts = [Filter.of(keys, left[i::3], right[i::3]) for i in range(3)]
    segment_bits = min(3, keys.widths[0])
    pieces = defaultdict(list)
    for p in parts:
        for s, f in p.segments(segment_bits):
            pieces[s].append(Filter.from_bytes(keys, f.to_bytes(segment_bits), s, segment_bits))
        back = Filter.from_bytes(keys, p.to_bytes())
        assert (back.left == p.left).all() and (back.right == p.right).all() and (back.count == p.count).all()
    got = {}
    for s in pieces:
        f = Filter.merged(keys, pieces[s])
        got |= dict(zip(zip(*(x.tolist() for x in keys.inverted(f.left, f.right))), f.count.tolist()))
    assert got == want


def test_large_counters_and_empty_filters():
    keys = Keys(2, 8)
    f = Filter.of(keys, np.array([3, 1, 3], np.uint64), np.array([4, 1, 4], np.uint64), np.array([1 << 40, 254, 255]))
    back = Filter.from_bytes(keys, f.to_bytes())
    assert back.count.tolist() == [254, (1 << 40) + 255] and back.left.tolist() == [1, 3]
    assert len(Filter.merged(keys, [])) == 0 and Filter.merged(keys, []).segments(2) == []


def test_keys_spread_evenly():
    """Small ids that repeat fill all ranges of keys alike."""
    left, _ = Keys(2, 20).permuted([np.repeat(np.arange(200, dtype=np.uint64), 200), np.tile(np.arange(200, dtype=np.uint64), 200)])
    sizes = np.bincount((left >> np.uint64(16)).astype(int), minlength=16)
    assert sizes.min() > 2100 and sizes.max() < 2900


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "  ", "\t", ".", "\n", "é", "\x85", "\xa0", "longer"]), max_size=60).map("".join))
def test_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    want = [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", lower)]
    got = [[]]
    for w in (w.decode() for some in C.words(text.encode()) for w in some):
        if w == ".":
            got.append([])
        else:
            got[-1].append(w)
    assert got == want


def test_slices_keep_words_whole(monkeypatch):
    text = b"some words, and a very-very-long-word here. End " * 50
    want = [w for some in C.words(text) for w in some]
    for size in (3, 10, 64):
        monkeypatch.setattr(C, "SLICE", size)
        assert [w for some in C.words(text) for w in some] == want


def planted(rows):
    extra = [("en", "New York City, new york. New york state! " * 4), ("en", "new york city"), (None, "a b c " * 12), ("und", "b c d " * 11), ("xx", "rare words only"), ("", "x y " * 20)]
    return [(r[2], r[1]) for r in rows] + extra * 3


@pytest.mark.parametrize("shard_words", [1 << 20, 200])
def test_operator(spark, rows, shard_words):
    data = planted(rows)
    docs = spark.createDataFrame([(a, b, "!", 1) for a, b in data], "lang string, text string, word string, n int").repartition(4)
    got = sorted(tuple(r) for r in C.collocations(docs, shard_words=shard_words).collect())
    assert got == slow(data) and len(got) >= 10
    got = sorted(tuple(r) for r in C.collocations(docs, least=3, top=7, covered=80, shard_words=shard_words).collect())
    assert got == slow(data, 3, 7, 80)


def test_awkward(spark, no_docs):
    assert C.collocations(no_docs).count() == 0
    docs = spark.createDataFrame([("en", None), (None, ""), ("en", " \t.,"), ("de", "one two")], "lang string, text string")
    assert C.collocations(docs).count() == 0


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op13_collocations(spark, sf).collect())
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == slow(rows)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(db.execute(queries.oracle_sql()["op13_collocations"]).fetchall()) == got
