import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from dualcheck.llm import backtrack_bpe

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(found: bytes) -> list[int]:
    return np.frombuffer(found, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aehinorst \n▁é日", max_size=60)))
def test_like_the_library(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found, decoded = backtrack_bpe.encoder(PATH).encode(text)
    assert ids(found) == model.encode(text) and decoded == model.decode([1] + model.encode(text) + [2])


def test_pieces_in_any_order(model):
    r = np.random.default_rng(2)
    e = backtrack_bpe.Encoder(PATH, cached=50)
    for _ in range(300):
        text = "".join(model.id_to_piece(int(i)) for i in r.integers(259, 32000, 6))
        assert ids(e.encode(text)[0]) == model.encode(text)


def test_operator(clashing, rows, no_docs, model):
    got = sorted(((r["doc_id"], ids(r["ids"]), r["decoded"]) for r in backtrack_bpe.encode(clashing, PATH).collect()), key=repr)
    want = [model.encode(r[1] or "", add_bos=True, add_eos=True) for r in rows]
    assert got == sorted(((r[0], w, model.decode(w)) for r, w in zip(rows, want)), key=repr)
    assert backtrack_bpe.encode(no_docs, PATH).count() == 0
