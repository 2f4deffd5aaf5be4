import numpy as np
import xxhash

from dualcheck.llm import simhash

from .conftest import collected


def slow_fingerprint(text: str) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs: list[tuple], radius: int = 3) -> list:
    """(id, fingerprint, smallest id reachable) by comparing all with all."""
    group = list(range(len(pairs)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(pairs):
            for j, (_, b) in enumerate(pairs):
                if (a ^ b).bit_count() <= radius and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    out = []
    for i, (d, f) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if group[j] == group[i] and pairs[j][0] is not None]
        out.append((d, f - (1 << 64) if f >> 63 else f, min(ids) if ids else None))
    return sorted(out, key=repr)


def test_fingerprint_is_the_majority_of_hashes(rows):
    for r in rows:
        assert simhash.fingerprint((r[1] or "").encode()) & (1 << 64) - 1 == slow_fingerprint(r[1] or "")


def test_whole_operator_against_all_pairs(clashing, rows):
    want = slow_components([(r[0], slow_fingerprint(r[1] or "")) for r in rows])
    assert collected(simhash.near_duplicates(clashing)) == want


def test_links_over_many_tiles(spark):
    r = np.random.default_rng(5)
    seeds = r.integers(0, 1 << 63, 6, dtype=np.int64)
    prints = sorted({int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in r.integers(0, 62, (40, 2))})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, tile=8)).collect()}
    pairs = slow_components([(i, p) for i, p in enumerate(prints)])
    first = {}
    for i, p, c in sorted(pairs):
        first.setdefault(c, p)
    want = {p: min(q for _, q, d in pairs if d == c) for _, p, c in pairs}
    assert {p: got.get(p, p) for p in prints} == want


def test_tiles_far_apart_by_population_count_never_meet(spark):
    r = np.random.default_rng(8)
    key = (1 << 26) - 1  # the first two blocks, so that all meet under one key
    low = [sum(1 << int(b) for b in r.choice(np.arange(26, 60), 3, replace=False)) | key for _ in range(60)]
    high = [sum(1 << int(b) for b in r.choice(np.arange(26, 60), 24, replace=False)) | key for _ in range(60)]
    prints = sorted({*low, *high})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    groups: dict[tuple, set] = {}
    for t in simhash.tile_pairs(df, tile=8).collect():
        groups.setdefault((t["t"], t["key"], t["first"], t["second"]), set()).add(t["fingerprint"])
    shared = [g for (t, _, first, second), g in groups.items() if first != second]
    assert shared and not any({p.bit_count() for p in g} >= {29, 50} for g in shared)
    # nothing is lost: whatever lies within the radius meets in some pair of tiles
    close = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    assert close and all(any(a in g and b in g for g in groups.values()) for a, b in close)


def test_one_of_each_keeps_the_smallest_id_and_all_columns(clashing, rows):
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    found = slow_components([(r[0], slow_fingerprint(r[1] or "")) for r in rows])
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids == sorted({c for _, _, c in found if c is not None})


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.one_of_each(no_docs).count() == 0
