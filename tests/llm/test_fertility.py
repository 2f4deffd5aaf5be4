import math
import re
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from dualcheck.llm import fertility

PATHS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")


def slow_counts(text: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def slow_rates(text: str) -> tuple:
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[0])
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    ids = [i for x in w for i in sp.encode(x)]
    if not ids:
        return None, None, None
    bits = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
    return sum(map(len, w)) / len(ids), sum(map(sp.is_byte, ids)) / len(ids), bits / math.log2(len(ids)) if len(ids) > 1 else 1.0


def test_counts_rates_and_verdict(clashing, rows):
    got = fertility.quality(clashing, *PATHS).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], (r[1] or "", r[2]))
    for g in got:
        text, lang = by_id[g["doc_id"]]
        counts = slow_counts(text)
        assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        assert (g["chars_per_token"], g["fallback_share"], g["token_entropy"]) == pytest.approx(slow_rates(text))
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert g["base_failed"] == failed and not (failed and g["kept"])
        if not failed:
            band = fertility.band_of(lang, text.encode(), fertility.BANDS)
            assert g["kept"] == band.holds(g["chars_per_token"], g["chars_per_token_multi"], g["fallback_share"], g["token_entropy"])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\n #é\t", max_size=80))
def test_base_counts(text):
    words = fertility._words(*PATHS, 1000)
    got = fertility._measure([text.encode()], ["en"], words, fertility.BANDS, 50, 50)
    assert tuple(got[k][0] for k in fertility._COUNTS) == slow_counts(text)


def test_a_small_cache_changes_nothing(rows):
    texts = [(r[1] or "").encode() for r in rows]
    langs = [r[2] for r in rows]
    small, large = (fertility.Words(*PATHS, n) for n in (10, 100_000))
    assert (fertility._measure(texts, langs, small, fertility.BANDS, 50, 50) == fertility._measure(texts, langs, large, fertility.BANDS, 50, 50))


def test_windows_of_many_different_words():
    import numpy as np
    numbers = np.array([1, 2, 3, 1 << 22, 1, 2, 3, 5, 6])
    assert fertility.repeated_words(numbers) == 6


def test_scripts_and_empty_table(no_docs):
    assert fertility.band_of("ru", "привет мир".encode(), fertility.BANDS) is fertility.SCRIPTS[1][2]
    assert fertility.band_of(None, b"123", fertility.BANDS) is fertility.OTHER
    assert fertility.quality(no_docs, *PATHS).count() == 0 and fertility.keep_good(no_docs, *PATHS).count() == 0


def test_keep_good_keeps_columns(clashing):
    kept = fertility.keep_good(clashing, *PATHS)
    want = fertility.quality(clashing, *PATHS).filter("kept").count()
    assert kept.columns == clashing.columns and kept.count() == want > 0


def test_rows_of_table_cells_go_and_long_clean_text_stays():
    cells = ("Anananin | haheen, | therer | hastth, | andonatshwh | oftheablely | Onlyon | andheinhetion | oninging | erheaned | heanlyst | "
             "theronon | ndthti | lytiou | erthing | thshou. | thenwhat | ofthonenti | edonre | ofoninerre | esontion. | Ortiha | be.\nOrtionst | "
             "erheerre | ndingti. | theningea. |")
    got = fertility._measure([cells.encode()], ["en"], fertility.Words(*PATHS, 1000), fertility.BANDS, 50, 50)
    assert not got["base_failed"][0] and not got["kept"][0]
    # entropy falls with length beyond the longest labelled document; a short text of the same entropy goes
    band = fertility.BANDS["de"]
    assert band.holds(2.24, 2.31, 0.0, 0.437, 20_020) and not band.holds(2.24, 2.31, 0.0, 0.437, 200)
