from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dualcheck.llm.vector_packing import Limits, Packer, Piece, WordTokenizer, pack

PATH = P.path("word_bpe_49k.json")


WHOLE = Tokenizer.from_file(PATH)
WORDS = WordTokenizer(PATH, 5)
QUOTED_WHOLE = Tokenizer.from_file(PATH)
QUOTED_WHOLE.encode_special_tokens = True
QUOTED_WORDS = WordTokenizer(PATH, 5, quoted=True)
MARKED = st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", " ", "a", "\x01"]), st.text(max_size=8)), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), MARKED), max_size=8))
def test_words_encode_like_whole_texts(texts):
    for words, whole in ((WORDS, WHOLE), (QUOTED_WORDS, QUOTED_WHOLE)):
        assert [x.tolist() for x in words.encode([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_marks_inside_texts(spark):
    """As the plain call has them: one token, with its own id."""
    docs = spark.createDataFrame([(1, "hello <|endoftext|> world"), (2, "x<|startoftext|>y")], "doc_id long, text string")
    got = defaultdict(list)
    for r in sorted(pack(docs, PATH).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert got[1] == [3306, 49407, 1002, 1] and got[2] == WHOLE.encode("x<|startoftext|>y", add_special_tokens=False).ids + [1]
    quoted = {r["doc_id"]: r["doc_tokens"] for r in pack(docs, PATH, quoted=True).collect()}
    assert quoted[1] == len(QUOTED_WHOLE.encode("hello <|endoftext|> world", add_special_tokens=False).ids) + 1 > 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=60), st.integers(1, 6), st.integers(1, 32), st.integers(1, 12))
def test_limits_and_whole_cover(items, segments, loss, pool):
    limits = Limits(32, segments, loss)
    packer, out = Packer(limits, pool), []
    for i, (n, prompt) in enumerate(items):
        out += packer.add(Piece(i, np.arange(n), 0, min(prompt, n), n))
    out += packer.flush()
    seen = defaultdict(list)
    for sequence in out:
        size = sum(len(p.ids) for p in sequence)
        assert size == 32 or size & (size - 1) == 0 and 0 < size < 32
        assert sum(p.loss for p in sequence) <= loss and len(sequence) <= segments
        for p in sequence:
            seen[p.id] += p.ids.tolist()
            assert len(p.ids) and p.ids[0] == p.start
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(n)) for i, (n, _) in enumerate(items)}


def slow_pack(sizes: list[tuple[int, int]], limits: Limits) -> list[list[int]]:
    """Which pieces (tokens, loss) go together: of those that fit, always the first of the greatest dot product of
    its size with what is left, both as shares of the limits; exact in fractions. Nothing is cut."""
    whole = (limits.tokens, limits.segments, limits.loss)
    open_, out = dict(enumerate((n, 1, loss) for n, loss in sizes)), []
    while open_:
        rest, chosen = list(whole), []
        while True:
            fits = {i: sum(Fraction(s * r, w * w) for s, r, w in zip(size, rest, whole)) for i, size in open_.items() if all(s <= r for s, r in zip(size, rest))}
            if not fits:
                break
            best = max(fits, key=lambda i: (fits[i], -i))
            rest = [r - s for r, s in zip(rest, open_.pop(best))]
            chosen.append(best)
        out.append(chosen)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 31), st.integers(0, 31)), max_size=30), st.sampled_from([1, 2, 4, 8]), st.sampled_from([1, 4, 16, 32]))
def test_the_greatest_dot_product_is_chosen(items, segments, loss):
    """Limits are powers of two, so that floating point is exact; sequences are compared before they are cut to length."""
    limits = Limits(32, segments, loss)
    sizes = [(n, min(n, bears, loss)) for n, bears in items]
    groups = []

    class Watched(Packer):
        def finished(self, pieces):
            groups.append([p.id for p in pieces])
            return []

    class Uncut(Piece):
        def cut(self, tokens, loss):
            return (self, None)
    packer = Watched(limits, 1 << 10)
    packer.pool = [Uncut(i, np.arange(n), 0, n - bears, n) for i, (n, bears) in enumerate(sizes)]
    packer.flush()
    assert groups == slow_pack(sizes, limits)


def test_operator(clashing, rows, no_docs):
    whole = WHOLE
    want = sorted((tuple(whole.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows))
    got = pack(clashing, PATH, pool_size=4).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        found = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(found) == r["length"] <= r["doc_tokens"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"], r["doc_tokens"]].append((r["start"], found))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    ids = sorted(sum((x for _, p in docs.items() for _, x in p), []))
    assert ids == sorted(i for w in want for i in w)
    assert sum(len(w) for w in want) == sum(r["length"] for r in got)
    assert pack(no_docs, PATH).count() == 0


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "answer words here", "a question"), (2, None, None), (3, "only", None)], "doc_id long, text string, prompt string")
    got = pack(docs, PATH, prompt_col="prompt").groupBy("doc_id").sum("loss_tokens", "length").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {1: (4, 6), 2: (1, 1), 3: (2, 2)}
