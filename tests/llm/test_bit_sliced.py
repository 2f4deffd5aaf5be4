import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dualcheck.llm import bit_sliced


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 150), st.integers(1, 5), st.integers(1, 40), st.integers(1, 25), st.integers(0, 1000))
def test_block_against_all_scores(n, width, spread, k, seed):
    r = np.random.default_rng(seed)
    q, ids, query = r.integers(-spread, spread + 1, (n, width)), r.permutation(n) * 3, r.integers(-spread, spread + 1, width)
    low, slices = bit_sliced.sliced(q)
    own = int(ids[0])
    got_ids, got = bit_sliced.best(query, own, ids, low, slices, k)
    score = q @ query
    want = [i for i in np.lexsort((ids, -score)) if ids[i] != own][:k]
    assert sorted(zip(got_ids.tolist(), got.tolist())) == sorted(zip(ids[want].tolist(), score[want].tolist()))


def test_operator(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 6)]) for i in range(300)]
    rows[40:80] = [(i, rows[40][1]) for i in range(40, 80)]
    odd = [(500, None), (520, [0.1, None, 0.0]), (540, [float("nan")] * 6), (560, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd + [rows[20]], "vec_id long, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in ("id", "q", "block", "rank")))
    got = bit_sliced.top_k(df, df.filter("vec_id % 20 = 0"), 20, block=64).collect()
    held = rows + [rows[20]]
    m = np.floor(64 * np.array([v for _, v in held], np.float32).astype(float)).astype(int)
    ids = np.array([i for i, _ in held])
    want = set()
    for q in range(0, 300, 20):
        score = m @ m[q]
        for rank, i in enumerate([i for i in np.lexsort((ids, -score)) if ids[i] != q][:20], 1):
            want.add((q, rank, int(ids[i]), int(score[i])))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5, 2.0]), (2, [])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, bit_sliced.top_k(df, df.filter("vec_id = 0"), 20).collect())) == [(0, 1, 1, 2048), (0, 2, 2, 0)]
    none = df.limit(0)
    assert bit_sliced.top_k(none, none).count() == 0 and bit_sliced.top_k(df, none).count() == 0
