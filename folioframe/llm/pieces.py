"""Exact encoding of page texts with a merge-type piece vocabulary, and decoding."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache, partial
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioframe.llm.texts import BY, Memo, annotate

SPACE = "▁"
_NEVER = float("-inf")
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# Bounds of a worker's memory of segments and of parts between certain borders.
SEGMENTS, PARTS = 400_000, 350_000
FIELDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


class Pieces:
    """A vocabulary whose text is split by merging the best-scored neighbours, encoded without merging.

    Longest matches are taken from the left. A piece stays if it is compatible with the one before it, that is,
    if merging the two texts anew ends at the same border; otherwise the next shorter piece is tried, and
    positions from which nothing led on are marked in a bit field, so none is tried twice.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if not model.encode("a b") == model.encode("a b", add_bos=False, add_eos=False):
            raise ValueError("the model adds markers of its own")
        count = model.get_piece_size()
        self.names = [model.id_to_piece(k) for k in range(count)]
        plain = [k for k in range(count) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.ids = {self.names[k]: k for k in plain}
        self.scores = {self.names[k]: model.get_score(k) for k in plain}
        self.bytes = {int(self.names[k][3:5], 16): k for k in range(count) if model.is_byte(k)}
        self.unknown = model.unk_id()
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.high = {k for k, b in self.byte_of.items() if b > 127}
        self.surface = [n if n in self.ids else "" for n in self.names]
        for k, b in self.byte_of.items():
            self.surface[k] = chr(b) if b < 128 else ""
        self.surface[self.unknown] = model.decode([self.unknown])  # as the library shows it
        self.characters = {p for p in self.ids if len(p) == 1}
        # two characters that no piece holds side by side always have a border between them
        self.inside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:  # others never come out of merging
                self.matches.add_word(piece, (piece, len(piece) - 1))
        self.matches.make_automaton()
        self.fits = Memo(lambda pair: self.merged(pair[0] + pair[1]) == list(pair), PARTS, "pieces")
        self.parts = Memo(self._part, PARTS, "pieces")
        self.segments = Memo(self._segment, SEGMENTS, "pieces")

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best score first, the leftmost of equals."""
        symbols, score = list(text), self.scores.get
        joined = [score(x + y, _NEVER) for x, y in zip(symbols, symbols[1:])]
        while joined:
            best = max(joined)
            if best == _NEVER:
                break
            at = joined.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = score(symbols[at - 1] + symbols[at], _NEVER)
            if at < len(joined):
                joined[at] = score(symbols[at] + symbols[at + 1], _NEVER)
        return symbols

    def _part(self, text: str) -> tuple[int, ...]:
        """Ids of a text of known characters."""
        starts: list[list[tuple[str, int]]] = [[] for _ in text]  # pieces from each place and where they end, the shortest first
        for end, (piece, back) in self.matches.iter(text):
            starts[end - back].append((piece, end + 1))
        fits, n, at, last = self.fits, len(text), 0, None
        open_at = (1 << (n + 1)) - 1  # places that may still lead to the end
        chosen: list[str] = []
        tries = [len(starts[0]) - 1]
        while at < n:
            found, k = starts[at], tries[-1]
            while k >= 0:
                piece, after = found[k]
                if open_at >> after & 1 and (last is None or fits[last, piece]):
                    break
                k -= 1
            if k >= 0:
                tries[-1] = k - 1
                chosen.append(piece)
                at, last = after, piece
                tries.append(len(starts[at]) - 1 if at < n else -1)
            else:
                open_at &= ~(1 << at)
                tries.pop()
                if not chosen:
                    raise ValueError(f"no way to split {text!r}")
                at -= len(chosen.pop())
                last = chosen[-1] if chosen else None
        return tuple(map(self.ids.__getitem__, chosen))

    def _segment(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        start = 0
        for at in range(1, len(text) + 1):
            if at < len(text) and text[at - 1:at + 1] in self.inside:
                continue
            part = text[start:at]
            start = at
            if part in self.characters or len(part) > 1:
                ids += self.parts[part]
            elif self.bytes:
                ids += [self.bytes[b] for b in part.encode()]
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of each stretch from one space to the next; no piece reaches across."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.segments.__getitem__, _SEGMENT.findall(SPACE + text.replace(" ", SPACE)))))

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, the space put before the text removed."""
        if self.high.isdisjoint(ids):  # every byte piece is a character of its own
            out = list(map(self.surface.__getitem__, ids))
        else:
            out, held = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(_utf8(held))
                    held = bytearray()
                out.append(self.surface[i])
            if held:
                out.append(_utf8(held))
        if ids and self.names[ids[0]].startswith(SPACE):
            out[0] = out[0][1:]
        return "".join(out).replace(SPACE, " ")


def _utf8(raw: bytearray) -> str:
    """Bytes as text; each byte that fits nowhere becomes a replacement mark."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at:at + e.start].decode())
            out.append("�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _encode(texts, path):
    model = pieces_of(path)
    ids, decoded = [], []
    for text in texts:
        got = model.encode(text or "")
        ids.append(got)
        decoded.append(model.decode(got))
    return [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]


def encode_pages(pages: DataFrame, model_path: str, text: str = "text", by: Sequence[str] = BY, carry: Sequence[str] = ()) -> DataFrame:
    """``ids`` of every page text, as the vocabulary's own library gives them without markers, and ``decoded`` text.

    A null text counts as empty: no ids, an empty decoded text. Repeated rows stay; other columns are left out
    unless carried. Whole texts, no shuffle. ``model_path`` is read in each worker, so all need it in that place.
    """
    return annotate(pages, [*by, *carry], text, FIELDS, partial(_encode, path=model_path), owner="pieces")
