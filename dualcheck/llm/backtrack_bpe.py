"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A merge encoder joins, again and again, the adjacent pair whose joint piece has
the best score (leftmost among equals). Its result is the only split of a text
into pieces in which every two neighbours are compatible: merging the two
pieces' characters afresh gives the same two pieces. So the encoder goes from
left to right, takes the longest piece that an Aho-Corasick automaton finds at
the place, checks it against the piece before by re-merging, tries shorter
ones, and steps back where none fits. A bitfield marks positions from which no
split can reach the place before, so that each is given up once.

Characters that are pieces of nothing fall back to byte pieces, which never
merge. Text is encoded chunk by chunk: no piece spans the start of a run of word
marks, nor a character that no longer piece holds; what a chunk gives is kept
for the next time, within a bound. The model's own normaliser must be the
identity with a mark in front, which is checked when it is loaded.
"""
from __future__ import annotations

import re
from functools import cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType

from .common import map_batches, texts_and_ids, with_id

MARK = "▁"
#: Chunks that a task keeps in each of two generations.
CACHED_CHUNKS = 300_000
#: Pairs of pieces whose compatibility a task keeps.
CACHED_PAIRS = 1 << 19
#: Longer chunks are encoded each time.
CACHED_LENGTH = 64


class Kept(dict):
    """What chunks gave; two generations of bounded size, so that frequent chunks stay."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, chunk: str):
        found = self.old.get(chunk)
        if found is None:
            found = self.make(chunk)
            if len(chunk) > CACHED_LENGTH:
                return found
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = found
        return found


class Encoder:
    """Encodes and decodes like the model's own library, without sampling. Inside, a space stands for the word mark."""

    def __init__(self, path: str, cached: int = CACHED_CHUNKS):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a\tb  ﬁ Å\n" + MARK
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalises texts; this encoder is for identity normalisers with a mark in front")
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.ids: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.score: dict[str, float] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace(MARK, " ")
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        if any(re.search("[^ ] ", p) for p in self.ids):
            raise ValueError("a piece spans the start of a word")
        self.piece = {i: p for p, i in self.ids.items()}
        self.at_byte = {i: b for b, i in self.byte.items()}
        self.tree = ahocorasick.Automaton()
        for p in self.ids:
            self.tree.add_word(p, len(p))
        self.tree.make_automaton()
        self.prefixes = {p: tuple(p[:k] for k in range(len(p), 0, -1) if p[:k] in self.ids) for p in self.ids}
        self.shorter = {p: x[1] for p, x in self.prefixes.items() if len(x) > 1}
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        self.chunks = re.compile(f"[{alone}]+| *[^ {alone}]+| +" if alone else " *[^ ]+| +")
        self.fit: dict[tuple[str, str], bool] = {}
        self.kept = Kept(self.encode_chunk, cached)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the characters of ``text`` ends with."""
        parts = list(text)
        joint = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(joint):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at:
                joint[at - 1] = self.score.get(parts[at - 1] + parts[at])
            if at < len(joint):
                joint[at] = self.score.get(parts[at] + parts[at + 1])

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces are compatible neighbours (no left one: whether merging makes the piece at all)."""
        found = left not in self.ids and bool(left) or right not in self.ids or self.merged(left + right) == ([left, right] if left else [right])
        if len(self.fit) >= CACHED_PAIRS:
            self.fit.clear()
        self.fit[left, right] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text; a character that is no piece stands alone and fits anything."""
        if not text:
            return []
        longest = [1] * len(text)
        for end, n in self.tree.iter(text):  # ends come in order, so the last one of a start is its longest
            longest[end - n + 1] = n
        fit, prefixes, size = self.fit, self.prefixes, len(text)
        dead = bytearray(size // 8 + 1)
        failed = False
        pieces: list[str] = []
        pos, last, take = 0, "", text[:longest[0]]
        while True:
            for piece in prefixes.get(take, (take,)) if take else ():
                end = pos + len(piece)
                if failed and dead[end >> 3] >> (end & 7) & 1:
                    continue
                ok = fit.get((last, piece))
                if ok or ok is None and self.fits(last, piece):
                    break
            else:
                dead[pos >> 3] |= 1 << (pos & 7)
                failed = True
                if not pieces:
                    raise ValueError("no split of the text is what merging gives")
                pieces.pop()
                pos -= len(last)
                take = self.shorter.get(last)
                last = pieces[-1] if pieces else ""
                continue
            pieces.append(piece)
            if end == size:
                return pieces
            pos, last = end, piece
            take = text[pos:pos + longest[pos]]

    def encode_chunk(self, text: str) -> tuple[bytes, str]:
        """The ids of a chunk as little-endian unsigned 32-bit integers, and what they decode to."""
        try:
            ids = [self.ids[p] for p in self.split(text)]
        except KeyError:
            ids = []
            for p in self.split(text):
                i = self.ids.get(p)
                ids += [i] if i is not None else [self.byte.get(b, self.unk) for b in p.encode("utf-8", "surrogatepass")]
        return pack(f"<{len(ids)}I", *ids), self.decode_chunk(ids)

    def decode_chunk(self, ids: list[int]) -> str:
        """The text of pieces, a run of byte pieces read as UTF-8."""
        try:
            return "".join([self.piece[i] for i in ids])
        except KeyError:
            pass
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.at_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.piece[i])
        return "".join(out) + run.decode("utf-8", "replace")

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text without begin and end ids, as bytes, and the text that they decode to."""
        if not text:
            return b"", ""
        found = list(map(self.kept.__getitem__, self.chunks.findall(" " + text.replace(MARK, " "))))
        return b"".join([x for x, _ in found]), "".join([x for _, x in found])[1:]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True,
           eos: bool = True) -> DataFrame:
    """(id, ids, decoded) of every row: the model's ids as little-endian unsigned 32-bit integers in one
    binary value, with begin and end ids if asked for, and the text that they decode to.

    A null or empty text has only the begin and end ids and decodes to an
    empty text. Repeated rows and ids are each returned; an empty table gives
    an empty result.
    """
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        head = np.array([e.bos] * bos, "<u4").tobytes()
        tail = np.array([e.eos] * eos, "<u4").tobytes()
        found = [e.encode(t) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([head + x + tail for x, _ in found], pa.binary()),
                                           pa.array([x for _, x in found], pa.string())], [id_col, "ids", "decoded"])
    return map_batches(texts_and_ids(docs, id_col, text_col), run, with_id(docs, id_col, ("ids", BinaryType()), ("decoded", StringType())))
