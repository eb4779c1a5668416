"""Token ids of page texts by a public tokenizer, with words that come again looked up."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from folioframe.llm.texts import Memo

# Bounds of a worker's memory of stretches and of words.
STRETCHES, WORDS = 350_000, 400_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
# In these characters every release of the character tables agrees on letters, numbers and spaces.
_OPEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _OPEN)}  # the byte-level vocabulary's signs for the other bytes
_STABLE = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*").fullmatch


class _MoreSpace(Exception):
    """A stretch between two single spaces is empty, or begins or ends with white space."""


class WordTokenizer:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The tokenizer splits a text into words before it merges; no word reaches across a single space. So a
    text is the sum of its stretches between spaces, and most stretches and words have been seen before.
    Every word's ids come from the library itself.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        shown = lambda text: [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        self.spaced = shown("a b") == ["a", "Ġb"]  # a word takes the space before it along
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" if self.spaced else r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
        self.split = regex.compile(words).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merge = self.library.model.tokenize
        self.words = Memo(self._word, WORDS, "tokens")
        self.first = Memo(self._stretch, STRETCHES // 8, "tokens")
        self.later = Memo(self._later if self.spaced else self._stretch, STRETCHES, "tokens")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word, which needs no further splitting: the library's merges alone."""
        ids = [t.id for t in self.merge(word.encode().decode("latin-1").translate(_SHOWN))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, text: str) -> bytes:
        body = text[1:] if self.spaced and text[:1] == " " else text
        if body.isascii() and body.isalpha():  # one word, whatever the pattern
            return self._word(text if self.spaced else text.lower())
        if not _STABLE(text):
            return self._whole(text)
        if not self.spaced:
            text = text.lower()
        found = self.split(text)
        return self.words[found[0]] if len(found) == 1 else b"".join(map(self.words.__getitem__, found))

    def _later(self, text: str) -> bytes:
        if not text or text[0].isspace() or text[-1].isspace():
            raise _MoreSpace  # the single space before it is no border; never remembered
        return self._stretch(" " + text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(map(text.__contains__, self.special)):
            return self._whole(text)
        parts = text.split(" ")
        try:
            if self.spaced and (not parts[0] or parts[0][-1].isspace()):
                raise _MoreSpace
            return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
        except _MoreSpace:
            first, *later = _CUT.split(text)
            return self._stretch(first) + b"".join(self._stretch(f" {p}") for p in later)


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    return WordTokenizer(path)
