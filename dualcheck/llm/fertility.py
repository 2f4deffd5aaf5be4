"""Quality rules from tokeniser fertility.

Two public vocabularies encode each word: a SentencePiece model with byte
fallback and a byte-level vocabulary for many languages. Per document this gives
characters per token under both, the share of byte-fallback tokens, and the
entropy of its tokens as a share of the greatest possible for so many tokens.
Each language has a band for every measure; a language without bands takes
those of the script that most of the text's letters belong to. A document
outside a band is rejected, and so is one that fails the base counts.

Words repeat, so a task encodes a word once and keeps its tokens by number; the
memory for that is bounded, and what doesn't fit is encoded again.
"""
from __future__ import annotations

import base64
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from .common import map_batches, only_one, raw_texts, slices, texts_and_ids, with_id

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
_NOT_COUNTED = SPACE + bytes(range(0x80, 0xC0))

#: Words whose tokens a task keeps.
CACHED_WORDS = 400_000


@dataclass(frozen=True)
class Band:
    """What a measure must lie within for a document to be kept."""
    min_piece: float  # characters per token of the SentencePiece model
    min_multi: float  # and of the vocabulary for many languages
    max_chars_per_token: float  # of either
    max_fallback: float
    min_entropy: float
    longest: int | None = None  # words up to which min_entropy holds; longer texts may have less

    def holds(self, piece: float, multi: float, fallback: float, entropy: float, words: int = 0) -> bool:
        least = self.min_entropy - (FALLING * math.log(words / self.longest) if self.longest and words > self.longest else 0)
        return (self.min_piece <= piece and self.min_multi <= multi and max(piece, multi) <= self.max_chars_per_token
                and fallback <= self.max_fallback and entropy >= least)


#: By how much clean labelled documents' entropy falls as the logarithm of the words grows by one.
FALLING = 0.076
#: From all labelled documents of sf0.1 that pass the base counts: 0.995 times the 0.001 quantile of the clean rates and 1.1
#: times the highest, and 0.995 times the lowest clean entropy, with the words of the longest clean document. None has byte
#: fallback, so that figure isn't derived. Words broken up by symbols or cell borders fall under the second figure.
BANDS: dict[str, Band] = {
    "en": Band(1.983, 2.053, 2.70, 0.05, 0.524, 4567),
    "de": Band(2.045, 2.154, 2.71, 0.05, 0.502, 4621),
    "es": Band(1.790, 1.910, 2.40, 0.05, 0.529, 2724),
    "fr": Band(1.676, 1.824, 2.48, 0.05, 0.489, 4871),
}
#: Scripts by the code points of their letters, with the bands for languages that have none; no document of those is labelled.
SCRIPTS: tuple[tuple[str, str, Band], ...] = (
    ("latin", "[A-Za-zÀ-ɏ]", Band(1.4, 1.7, 9.0, 0.05, 0.3)),
    ("cyrillic", "[Ѐ-ԯ]", Band(0.8, 1.0, 9.0, 0.2, 0.3)),
    ("greek", "[Ͱ-Ͽ]", Band(0.5, 0.8, 9.0, 0.3, 0.3)),
    ("han", "[぀-ヿ一-鿿가-힯]", Band(0.3, 0.3, 4.0, 0.8, 0.3)),
)
OTHER = Band(0.2, 0.2, 12.0, 0.95, 0.3)


def band_of(lang: str | None, text: bytes, bands: dict[str, Band]) -> Band:
    """The language's band, or that of the script of most letters."""
    if lang in bands:
        return bands[lang]
    decoded = text.decode("utf-8", "replace")
    counted = [(sum(1 for _ in re.finditer(pattern, decoded)), band) for _, pattern, band in SCRIPTS]
    most, band = max(counted, key=lambda x: x[0])
    return band if most else OTHER


class Words:
    """Numbers words and holds their tokens under both vocabularies."""

    def __init__(self, piece_path: str, multi_path: str, limit: int):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(multi_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.multi = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = self.pieces.vocab_size()
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.n = self.used = 0
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.bytes, self.other = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids = np.zeros(8192, np.int32)

    def add(self, new: list[bytes]) -> None:
        """Encode and number words that have no number yet."""
        texts = [w.decode("utf-8", "replace") for w in new]
        found = self.pieces.encode(texts, num_threads=1)
        length = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(length.sum()))
        other = np.fromiter((len(self.multi.encode_ordinary(" " + t)) for t in texts), np.int32, len(texts))
        n, used = self.n + len(new), self.used + len(flat)
        for name, need in (("start", n), ("length", n), ("bytes", n), ("other", n), ("ids", used)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(need, held.dtype)]))
        ends = np.cumsum(length, dtype=np.int64)
        begins = ends - length
        self.ids[self.used:used] = flat
        total = np.concatenate([[0], np.cumsum(self.fallback[flat])])
        self.start[self.n:n], self.length[self.n:n] = begins + self.used, length
        self.bytes[self.n:n], self.other[self.n:n] = total[ends] - total[begins], other
        self.number.update(zip(new, range(self.n, n)))
        self.n, self.used = n, used

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, valid until the next call."""
        new = set(words).difference(self.number)
        if self.n + len(new) > self.limit and self.n:
            self.clear()
            new = set(words)
        if new:
            self.add(list(new))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the words in order, and each word's count."""
        length = self.length[numbers]
        first = np.cumsum(length) - length
        return self.ids[np.repeat(self.start[numbers] - first, length) + np.arange(int(length.sum()))], length


def _words(piece_path: str, multi_path: str, limit: int) -> Words:
    return only_one(Words, piece_path, multi_path, limit)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside windows of three that occur twice or more, the first included."""
    if len(numbers) < 4:
        return 0
    if numbers.max() >= 1 << 21:
        pair = np.unique(numbers[:-2] << 32 | numbers[1:-1], return_inverse=True)[1]
        key = pair.astype(np.int64) << 32 | numbers[2:]
    else:
        key = numbers[:-2] << 42 | numbers[1:-1] << 21 | numbers[2:]
    ordered = np.sort(key)
    again = ordered[1:] == ordered[:-1]
    if not again.any():
        return 0
    twice = np.isin(key, ordered[1:][again])
    covered = np.zeros(len(numbers), bool)
    for i in range(3):
        covered[i:len(numbers) - 2 + i] |= twice
    return int(covered.sum())


def _entropies(tokens: np.ndarray, doc: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Entropy of each document's tokens over the logarithm of their number (one token or none: 1)."""
    total = np.bincount(doc, minlength=docs)
    key = np.sort(doc * size + tokens)
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts = np.concatenate([[0], cuts]) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(key)]])) if len(key) else starts
    weight = np.bincount(key[starts] // size, weights=counts * np.log2(counts), minlength=docs) if len(key) else np.zeros(docs)
    bits = np.log2(np.maximum(total, 1))
    return np.where(total > 1, (bits - weight / np.maximum(total, 1)) / np.maximum(bits, 1e-9), 1.0)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RATES = ("chars_per_token", "chars_per_token_multi", "fallback_share", "token_entropy")


def _measure(texts: list[bytes], langs: list[str | None], words: Words, bands: dict[str, Band],
             min_words: int, max_repeat: int) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in (*_COUNTS, *_RATES, "base_failed", "kept")}
    for lo, hi in slices(texts):
        split = [t.split() for t in texts[lo:hi]]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = words.numbers([w for x in split for w in x])
        doc = np.repeat(np.arange(len(split)), sizes)
        tokens, length = words.tokens(numbers)
        summed = lambda x: np.bincount(doc, weights=x, minlength=len(split))
        n_piece, n_bytes, n_multi = summed(length), summed(words.bytes[numbers]), summed(words.other[numbers])
        entropy = _entropies(tokens, np.repeat(doc, length), len(split), words.size)
        ends = np.cumsum(sizes)
        for i, (t, n) in enumerate(zip(texts[lo:hi], sizes.tolist())):
            chars = len(t.translate(None, _NOT_COUNTED))
            repeats = repeated_words(numbers[ends[i] - n:ends[i]])
            rates = ((chars / n_piece[i], chars / n_multi[i], n_bytes[i] / n_piece[i], float(entropy[i]))
                     if n else (None, None, None, None))
            failed = n < min_words or 100 * repeats > max_repeat * n
            row = (n, chars, len(t) - len(t.translate(None, SYMBOLS)), repeated_lines(t), repeats, *rates, failed,
                   not failed and band_of(langs[lo + i], t, bands).holds(*rates, n))
            for k, v in zip(out, row):
                out[k].append(v)
    return out


def quality(docs: DataFrame, piece_path: str, multi_path: str, bands: dict[str, Band] = BANDS, min_words: int = 50,
            max_repeat: int = 50, cached_words: int = CACHED_WORDS, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang") -> DataFrame:
    """Base counts, fertility measures, base_failed and kept of every row of ``docs``.

    A null text counts as empty: all counts zero, measures null, base_failed.
    A null or unknown language takes the bands of the text's script. Repeated
    rows and ids are judged one by one; an empty table gives an empty result.
    """
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = _measure(raw_texts(b.column(1)), b.column(2).to_pylist(), _words(piece_path, multi_path, cached_words),
                         bands, min_words, max_repeat)
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kinds[k]) for k, v in found.items())], [id_col, *found])
    kinds = dict.fromkeys(_COUNTS, pa.int64()) | dict.fromkeys(_RATES, pa.float64()) | dict.fromkeys(("base_failed", "kept"), pa.bool_())
    schema = with_id(docs, id_col, *((k, LongType()) for k in _COUNTS), *((k, DoubleType()) for k in _RATES),
                     ("base_failed", BooleanType()), ("kept", BooleanType()))
    return map_batches(texts_and_ids(docs, id_col, text_col, lang_col), run, schema)


def keep_good(docs: DataFrame, piece_path: str, multi_path: str, bands: dict[str, Band] = BANDS, min_words: int = 50,
              max_repeat: int = 50, cached_words: int = CACHED_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality`` keeps; text and language go in by their places, so other names don't matter."""
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = _measure(raw_texts(b.column(text_at)), b.column(lang_at).cast(pa.string()).to_pylist(),
                         _words(piece_path, multi_path, cached_words), bands, min_words, max_repeat)
        return b.filter(pa.array(found["kept"], pa.bool_()))
    return map_batches(docs, run, StructType(docs.schema.fields))
