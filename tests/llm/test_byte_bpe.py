import base64
import hashlib
import sys

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from dualcheck.llm import byte_bpe as B
from dualcheck.llm import queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "'s", "'re", "'", "abc", "the", "é", "日本", "12", "!?", "\xa0", "x" * 30, " " * 20, "-" * 25]), st.text(max_size=5)), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(found: bytes) -> list[int]:
    return np.frombuffer(found, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_like_the_library(library, text):
    e = B.encoder(PATH, P.PATTERN)
    assert ids(e.encode(text)) == library.encode_ordinary(text) and e.decode(e.encode(text)) == text.encode()


def test_every_code_point(library):
    """The pattern's classes and the bytes of every character, beside a letter, a digit, itself and a space."""
    e = B.encoder(PATH, P.PATTERN)
    for lo in range(0, sys.maxunicode, 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}." for c in range(lo, min(lo + 4096, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000)
        assert ids(e.encode(text)) == library.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aeinorst'é日 \n", min_size=1, max_size=300))
def test_long_pieces(text):
    e = B.encoder(PATH, P.PATTERN)
    assert e.merge_many(text.encode()) == e.merge_few(text.encode())


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 60))
def test_boundaries_hold_whatever_follows(text, size):
    """What a chunk says of its start holds in the whole text, and what it shares with a chunk from further left is right from there on."""
    e = B.encoder(PATH, P.PATTERN)
    whole = e.boundaries(text, True)
    found = e.boundaries(text[:size], size >= len(text))
    assert found.tolist() == whole[:len(found)].tolist()


def test_operator(clashing, rows, no_docs, library):
    """Whole, and in chunks so small that words are longer than the overlap."""
    want = sorted(((r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=repr)
    for chunk, overlap in ((1 << 16, 256), (1000, 64), (60, 6)):
        got = B.encode(clashing, PATH, P.PATTERN, chunk=chunk, overlap=overlap).collect()
        assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=repr) == want
    assert B.encode(no_docs, PATH, P.PATTERN).count() == 0


def test_runs_longer_than_chunks(spark, library):
    """Pre-tokens over many chunks, at both ends, alone, one after the other, and copies of one row."""
    texts = ["x" * 500, "a b " * 40 + "y" * 300 + " c d " * 30 + " " * 333, " " * 250 + "z" * 250 + "!" * 250 + "1" * 250, "ab " * 200, "'" + "re'" * 200]
    data = [(i % 4, t) for i, t in enumerate(texts + texts[:2])]
    got = B.encode(spark.createDataFrame(data, "doc_id long, text string"), PATH, P.PATTERN, chunk=50, overlap=10).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((i, library.encode_ordinary(t)) for i, t in data)


def test_chunks_meet_in_the_overlap(spark):
    """Ordinary text needs no second round: each chunk meets its neighbour where a word starts."""
    docs = spark.createDataFrame([(1, "some words of ordinary text, " * 400)], "id long, text string")
    chunks = B.cut(docs, B._chunk_schema(docs, "id"), 1000, 64).cache()
    pairs = B.neighbours(B.pretokenised(chunks, PATH, P.PATTERN, 1000, 64))
    found = [tuple(r) for r in pairs.orderBy("chunk").collect()]
    assert len(found) == chunks.count() - 1 > 10 and all(m is not None and 936 * c <= m < 936 * c + 64 for _, c, _, m in found)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(found)).hexdigest())
    assert got == want


def test_refuses(docs):
    with pytest.raises(ValueError):
        B.encode(docs, PATH, P.PATTERN, chunk=10, overlap=8)
    with pytest.raises(ValueError):
        B.Encoder(PATH, r"\p{L}+").boundaries("a b", True)
