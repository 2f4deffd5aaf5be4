"""Vector bin packing of tokenised examples into training sequences.

An example has tokens, is one segment, and bears loss on the tokens after its
prompt. A sequence is limited in all three at once. The dot-product heuristic
fills one sequence at a time: of the examples that fit, it takes the one whose
sizes, as shares of the limits, have the largest dot product with what the
sequence has left. When none fits whole, the largest one is cut to fill the gap.
What can't be filled to the full length (too many segments, or no examples left)
is cut into sequences of powers of two, which need no padding.

A task tokenises its rows and packs them as they come from a pool of bounded
size, so no row is shuffled and no key can be hot; a sequence never spans tasks.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .common import only_one, raw_texts, slices, texts_and_ids, with_id

#: Words whose ids a task keeps, in each of two generations.
CACHED_WORDS = 600_000
#: A mark that is a token of its own, and how it stands between words.
BETWEEN = b"\x01"
SPACED = b" " + BETWEEN + b" "
#: Words of Latin letters that stay letters when lower-cased, with one sign behind them or none.
SIGNS = frozenset((b".", b",", b";", b":", b"!", b"?"))
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,;:!?]?")


class WordTokenizer:
    """Ids of texts under a vocabulary whose tokens never span ASCII white space; a word is encoded once.

    The strings of special tokens inside a text have those tokens' ids, as in the
    library's plain call; with ``quoted`` they are encoded like any other text.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS, quoted: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = quoted
        mark = self._ids(BETWEEN)
        if len(mark) != 1:
            raise ValueError("the mark between words must be one token of the vocabulary")
        self.between, self.limit = int(mark[0]), limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, texts: list[list[bytes]]) -> None:
        """Make sure that the ids of all words of these texts are kept."""
        need = set().union(*texts)
        new = need.difference(self.kept)
        if len(self.kept) + len(new) > self.limit:
            self.old, self.kept = self.kept, {}
            new = need
        for w in [w for w in new if w in self.old]:
            self.kept[w] = self.old[w]
        new = [w for w in new if w not in self.kept]
        simple, plain = [], []
        for w in new:
            if SIMPLE.fullmatch(w.decode("utf-8", "replace")):
                simple.append(w)
            elif BETWEEN not in w:
                plain.append(w)
        for lo in range(0, len(simple), 4096):
            # letters end in one token that ends a word, and a sign behind them is another
            part = simple[lo:lo + 4096]
            ids = self._ids(b" ".join(part))
            stops = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([1 + (w[-1:] in SIGNS) for w in part])
            if last[-1] != len(stops):
                plain += part
                continue
            cuts = stops[last - 1].tolist()
            self.kept.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, [0, *cuts], cuts))
        for lo in range(0, len(plain), 4096):
            # other words are one text, with a mark between them whose id no other word has
            part = plain[lo:lo + 4096]
            ids = self._ids(SPACED.join(part))
            cuts = np.flatnonzero(ids == self.between).tolist()
            self.kept.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]))
        self.kept.update((w, self._ids(w).tobytes()) for w in new if BETWEEN in w)

    def _ids(self, text: bytes) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)
        return np.array(found[0].ids, "<u4")

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        self.learn(split)
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, x)), "<u4") for x in split]


def _tokenizer(path: str, quoted: bool) -> WordTokenizer:
    return only_one(WordTokenizer, path, CACHED_WORDS, quoted)


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


@dataclass
class Piece:
    """Tokens of an example from ``start`` on; those before the example's place ``prompt`` bear no loss."""
    id: object
    ids: np.ndarray
    start: int
    prompt: int
    total: int

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.prompt))

    def cut(self, tokens: int, loss: int) -> tuple[Piece, Piece | None]:
        """A first part within both limits, and the rest."""
        n = min(len(self.ids), tokens, max(0, self.prompt - self.start) + loss)
        rest = Piece(self.id, self.ids[n:], self.start + n, self.prompt, self.total) if n < len(self.ids) else None
        return Piece(self.id, self.ids[:n], self.start, self.prompt, self.total), rest


@dataclass
class Packer:
    """Packs pieces from a pool; ``add`` and ``flush`` return finished sequences."""
    limits: Limits
    pool_size: int = 1024
    pool: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> list[list[Piece]]:
        out = []
        rest: Piece | None = piece
        while rest is not None:
            first, rest = rest.cut(self.limits.tokens, self.limits.loss)
            if len(first.ids) == self.limits.tokens:
                out.append([first])
            else:
                self.pool.append(first)
        return out + (self.pack(self.pool_size // 2) if len(self.pool) >= self.pool_size else [])

    def flush(self) -> list[list[Piece]]:
        return self.pack(0)

    def pack(self, leave: int) -> list[list[Piece]]:
        """Fill sequences until at most ``leave`` pieces are in the pool."""
        limit = self.limits.vector
        pool, out = self.pool, []
        size = np.array([(len(p.ids), 1, p.loss) for p in pool], float).reshape(-1, 3)
        open_ = np.ones(len(pool), bool)
        left = len(pool)
        while left > leave:
            rest, chosen = limit.copy(), []
            while left:
                # a piece that is packed has a size that never fits
                score = np.where((size <= rest).all(1), (size / limit) @ (rest / limit), -1.0)
                best = int(score.argmax())
                if score[best] < 0:
                    break
                chosen.append(pool[best])
                rest -= size[best]
                size[best], open_[best] = 1e18, False
                left -= 1
                if rest[0] < 1 or rest[1] < 1:
                    break
            if left and rest[0] >= 1 and rest[1] >= 1:
                k = int(np.where(open_, size[:, 0], -1.0).argmax())
                first, more = pool[k].cut(int(rest[0]), int(rest[2]))
                if len(first.ids) and more is not None:
                    chosen.append(first)
                    pool[k], size[k] = more, (len(more.ids), 1, more.loss)
            out += self.finished(chosen)
        self.pool = [p for p, o in zip(pool, open_.tolist()) if o]
        return out

    def finished(self, pieces: list[Piece]) -> list[list[Piece]]:
        """One sequence of full length, or several of powers of two."""
        total = sum(len(p.ids) for p in pieces)
        if total == self.limits.tokens:
            return [pieces]
        out, queue = [], list(reversed(pieces))
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            out.append([])
            while room:
                first, rest = queue.pop().cut(room, self.limits.loss)
                out[-1].append(first)
                room -= len(first.ids)
                if rest is not None:
                    queue.append(rest)
        return out


def pack(docs: DataFrame, path: str, end_id: int = 1, limits: Limits = Limits(), pool_size: int = 1024,
         id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, quoted: bool = False) -> DataFrame:
    """Pieces of examples in sequences: id, start, length, ids (little-endian unsigned 32-bit integers),
    loss_tokens, doc_tokens, sequence_id and offset.

    An example is its prompt, if ``prompt_col`` names one, its text and
    ``end_id``; the prompt bears no loss. Each token lies in exactly one piece.
    Strings of special tokens inside a text get those tokens' ids, or with
    ``quoted`` those of ordinary text, so that no text can end a document.
    A null text or prompt counts as empty, so every row gives its end id.
    Repeated rows and ids are packed one by one; an empty table gives an empty
    result. ``limits.loss`` must be positive.
    """
    rows = texts_and_ids(docs, id_col, text_col, *([prompt_col] if prompt_col else []))
    if prompt_col:
        rows = rows.withColumn("c0", F.coalesce(F.col("c0").cast("string"), F.lit("")))
    schema = with_id(docs, id_col, ("start", LongType()), ("length", LongType()), ("ids", BinaryType()), ("loss_tokens", LongType()),
                     ("doc_tokens", LongType()), ("sequence_id", LongType()), ("offset", LongType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = _tokenizer(path, quoted), Packer(limits, pool_size)
        next_id = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4")
        kind = None

        def emit(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            cols: list[list] = [[] for _ in range(8)]
            for pieces in sequences:
                at = 0
                for p in pieces:
                    for col, v in zip(cols, (p.id, p.start, len(p.ids), p.ids.tobytes(), p.loss, p.total, next_id, at)):
                        col.append(v)
                    at += len(p.ids)
                next_id += 1
            if cols[0]:
                kinds = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], schema.fieldNames())
        for b in batches:
            kind = b.schema.field(0).type
            ids, texts = b.column(0).to_pylist(), raw_texts(b.column(1))
            prompts = raw_texts(b.column(2)) if prompt_col else None
            for lo, hi in slices(texts):
                found = tokenizer.encode(texts[lo:hi])
                before = tokenizer.encode(prompts[lo:hi]) if prompts else None
                done = []
                for i, x in enumerate(found):
                    head = len(before[i]) if before else 0
                    whole = np.concatenate([*([before[i]] if before else []), x, end])
                    done += packer.add(Piece(ids[lo + i], whole, 0, head, len(whole)))
                yield from emit(done)
        yield from emit(packer.flush())
    return rows.mapInArrow(run, schema)
