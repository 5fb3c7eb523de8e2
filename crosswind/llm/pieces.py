"""Encoding into vocabulary pieces by a streaming Viterbi search, and decoding.

The search keeps best scores for the positions that a piece may still reach, at most the longest piece's length of them, and
backpointers since the last boundary it committed. When no piece passes over a position, or when the backpointer paths of
all surviving positions meet in one boundary, the ids up to there are final and handed out. A chunk between two places that
no piece of the vocabulary can pass over (before a run of word marks, around line ends) is searched once and remembered.

Scores: a unigram vocabulary's own log probabilities. A BPE vocabulary has merge ranks only; its pieces then get log
probabilities falling with rank by Zipf's law, -ln(rank + 2.7).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks up to this length are remembered, this many of them at most; the memory is emptied when full.
REMEMBERED_CHARS, REMEMBERED = 48, 400_000
ZIPF_SHIFT = 2.7


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary with byte fallback, and the search over it."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.scores, self.byte_ids = scores, byte_ids
        self.longest = max(map(len, scores))
        self.prefixes = {p[:k] for p in scores for k in range(1, len(p) + 1)}
        self.byte_score = min(s for _, s in scores.values()) - 10
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, (i, _) in scores.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        crossing = any(MARK in p.lstrip(MARK) for p in scores)
        lines = any("\n" in p and len(p) > 1 for p in scores)
        self.chunks = None if crossing else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if lines else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        #: Ids of chunks, as the bytes of an array of ints; and the chunks whose ids don't decode to them.
        self.memory: dict[str, bytes] = {}
        self.inexact: set[str] = set()
        #: Each prefix of a piece, with its id and score if it is a piece itself.
        self.table = {p: scores.get(p, (-1, 0.0)) for p in self.prefixes}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        own = {i: model.get_score(i) for i in plain}
        by_rank = sorted(plain, key=lambda i: (-own[i], i))
        ranks = all(s == int(s) for s in own.values())  # merge order, not log probabilities
        if ranks:
            own = {i: -log(r + ZIPF_SHIFT) for r, i in enumerate(by_rank)}
        return cls({model.id_to_piece(i): (i, own[i]) for i in plain}, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def search(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of the concatenation of parts. Of equal scores the path whose last piece is longer wins."""
        scores, prefixes, longest = self.scores, self.prefixes, self.longest
        text, at, reach = "", 0, 0  # text since the last commit; next start; furthest end of a piece so far
        best: list[float | None] = [0.0]
        back: list[tuple[int, int]] = [(0, 0)]
        checked = 0

        def path(end: int) -> list[int]:
            ids: list[int] = []
            while end:
                start, piece = back[end]
                ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(text[start:end].encode())]
                end = start
            return ids[::-1]

        parts, ended = iter(parts), False
        while True:
            while not ended and len(text) < at + longest:
                part = next(parts, None)
                ended = part is None
                text += part or ""
            if at and reach == at:  # no piece passes over: every path goes through here
                yield from path(at)
                text, at, reach, best, back, checked = text[at:], 0, 0, [0.0], [(0, 0)], 0
            if at >= len(text):
                return
            if at - checked >= 4 * longest:
                checked, meet = at, {j for j in range(at, reach + 1) if best[j] is not None}
                while len(meet) > 1:
                    last = max(meet)
                    meet.remove(last)
                    meet.add(back[last][0])
                if common := meet.pop():
                    yield from path(common)
                    text, at, reach, checked = text[common:], at - common, reach - common, at - common
                    best, back = best[common:], [(max(0, s - common), p) for s, p in back[common:]]
            grow = at + longest + 1 - len(best)
            if grow > 0:
                best += [None] * grow
                back += [(0, 0)] * grow
            here, single = best[at], False
            for end in range(at + 1, min(at + longest, len(text)) + 1):
                piece = text[at:end]
                if piece not in prefixes:
                    break
                if found := scores.get(piece):
                    single |= end == at + 1
                    score = here + found[1]
                    if best[end] is None or score > best[end]:
                        best[end], back[end] = score, (at, found[0])
                    reach = max(reach, end)
            if not single:
                score = here + self.byte_score * len(text[at].encode())
                if best[at + 1] is None or score > best[at + 1]:
                    best[at + 1], back[at + 1] = score, (at, -1)
                reach = max(reach, at + 1)
            at += 1

    def search_short(self, text: str) -> array:
        """As ``search``, in one pass with all positions kept: for a text of a few characters."""
        table, n = self.table, len(text)
        low = float("-inf")
        best, back, via = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        for at in range(n):
            here, single = best[at], False
            for end in range(at + 1, n + 1):
                found = table.get(text[at:end])
                if found is None:
                    break
                piece, score = found
                if piece >= 0:
                    if end == at + 1:
                        single = True
                    score += here
                    if score > best[end]:
                        best[end], back[end], via[end] = score, at, piece
            if not single:
                score = here + self.byte_score * len(text[at].encode())
                if score > best[at + 1]:
                    best[at + 1], back[at + 1], via[at + 1] = score, at, -1
        ids: list[int] = []
        while n:
            if via[n] >= 0:
                ids.append(via[n])
            else:
                ids += [self.byte_ids[b] for b in reversed(text[back[n] : n].encode())]
            n = back[n]
        ids.reverse()
        return array("i", ids)

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) > REMEMBERED_CHARS:
            ids = array("i", self.search(chunk[k : k + 4096] for k in range(0, len(chunk), 4096)))
            return ids.tobytes()
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
            self.inexact.clear()
        ids = self.search_short(chunk)
        if b"".join(map(self.bytes_of.__getitem__, ids)) != chunk.replace(MARK, " ").encode():
            self.inexact.add(chunk)
        found = self.memory[chunk] = ids.tobytes()
        return found

    def _marked(self, text: str) -> tuple[array, bool]:
        """Ids of a text whose marks stand for spaces, and whether each chunk's were decoded to it."""
        if self.chunks is None:
            return array("i", self.search(text[k : k + 4096] for k in range(0, len(text), 4096))), False
        chunks = self.chunks.findall(text)
        found, sure = list(map(self.memory.get, chunks)), True
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self._chunk(chunks[k])
                    sure &= len(chunks[k]) <= REMEMBERED_CHARS
        if self.inexact:
            sure &= self.inexact.isdisjoint(chunks)
        ids = array("i")
        ids.frombytes(b"".join(found))
        return ids, sure and sum(map(len, chunks)) == len(text)

    def encode(self, text: str) -> array:
        """Ids of text behind one space; none for an empty text. A mark in the text itself is taken as its bytes."""
        return self.encoded(text)[0]

    def encoded(self, text: str) -> tuple[array, bool]:
        """Ids of ``encode``, and whether they decode to text: each chunk's ids are decoded when they are remembered, and all ids of
        a text that has other chunks, or marks of its own."""
        if not text:
            return array("i"), self.decode(()) == text
        head, *rest = text.split(MARK)
        ids, sure = self._marked(MARK + head.replace(" ", MARK))
        for x in rest:
            ids.extend(self.byte_ids[b] for b in MARK.encode())
            ids.extend(self._marked(x.replace(" ", MARK))[0])
        return ids, sure and not rest or self.decode(ids) == text

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, n_ids and exact (decoding the ids gives the text back) for every row; row-wise, no shuffle.

    A null text: null ids, n_ids 0, exact null. An empty one: no ids. Other columns are dropped.
    """
    path = path or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                found, exact = zip(*((None, None) if x is None else pieces.encoded(x) for x in batch.column(1).to_pylist()))
                offsets, values = [0], array("i")
                for ids in found:
                    values.extend(ids or ())
                    offsets.append(len(values))
                lists = pa.ListArray.from_arrays(pa.array([None if ids is None else o for ids, o in zip(found, offsets)] + offsets[-1:], pa.int32()), pa.array(memoryview(values), pa.int32()) if values else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([len(ids or ()) for ids in found], pa.int64()), pa.array(exact, pa.bool_())], names)

    names = [id_col, "ids", "n_ids", "exact"]
    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(encode, f"{id_col} {dict(rows.dtypes)[id_col]}, ids array<int>, n_ids long, exact boolean")


def decoded(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the text of each row's ids; null for null. Ids outside the vocabulary raise KeyError."""
    path = path or vocabulary_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if ids is None else pieces.decode(ids) for ids in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    rows = rows.select(F.col(id_col), F.col(ids_col))
    return rows.mapInArrow(decode, f"{id_col} {dict(rows.dtypes)[id_col]}, text string")
