"""The pipeline against the stages' brute-force versions, one after the other."""
from collections import defaultdict

import corpus_pipeline
import public_tokenizers as P
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import __spark_entry__ as E
from dualcheck.llm import fertility, secret_scan

from .test_simhash import slow_components, slow_fingerprint
from .test_suffix_dedup import slow as slow_repeats

SF = "/root/testdata/sf0.001"


def slow_cut(texts, n=200):
    """Texts without the bytes that repeated strings cover, incomplete characters dropped."""
    from collections import Counter
    raw = [t.encode() for t in texts]
    times = Counter(t[i:i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if times[t[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        out.append(bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_strings", "live_secrets", "packing"]
    assert sum(n.startswith("op") for n in E.queries()) == 13 and "pipeline" in E.queries()


def test_whole_pipeline(spark):
    rows = [r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    words = fertility.Words(P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), 1 << 20)
    kept = fertility._measure([r["text"].encode() for r in rows], [r["lang"] for r in rows], words, fertility.BANDS, 50, 50)["kept"]
    rows = [r for r, k in zip(rows, kept) if k]
    first = {c for _, _, c in slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in first]
    assert len(slow_repeats([r["text"] for r in rows], 200)) == len(rows)
    texts = slow_cut([r["text"] for r in rows])
    owners = defaultdict(set)
    found = [secret_scan.scan(t) for t in texts]
    for r, spans in zip(rows, found):
        for s in spans:
            owners[s[4]].add(r["source"])
    masked = []
    for t, spans in zip(texts, found):
        out, at = "", 0
        for s, _, e, _, v in sorted(spans):
            if not secret_scan.placeholder(v) and len(owners[v]) < secret_scan.SHARED_OWNERS:  # scan() gives no others that don't look live
                if s >= at:
                    out += t[at:s] + "[SECRET]"
                at = max(at, e)
        masked.append(out + t[at:])
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r["doc_id"]: whole.encode(t, add_special_tokens=False).ids + [1] for r, t in zip(rows, masked)}
    import numpy as np
    got = defaultdict(list)
    for r in E.queries()["pipeline"](spark, SF).collect():
        got[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {d: [i for _, x in sorted(p) for i in x] for d, p in got.items()} == want
