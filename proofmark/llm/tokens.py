"""Token ids of whole texts by a tokenizers file, with the ids of repeated words kept per worker.

The two supported kinds of file never let a token cross a space between words,
so a text's ids are those of its words in turn.  A word is encoded once by the
library's model and looked up afterwards.  Texts or words for which that could
differ (odd white space, special tokens, letters beyond the Latin blocks) go
through the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import regex

#: Words kept per worker; beyond it the table starts afresh, so its memory is bounded.
KEPT = 700_000

SIMPLE = re.compile(r"[\n\x20-\x7e\xa1-\xac\xae-įı-ɏ]+")
CONTROL = re.compile(r"[\x1c-\x1f]")
#: How the two published vocabularies cut text into words.
WORD_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

LOADED: dict[str, Encoder] = {}


def _letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + odd.index(b)) for b in range(256)]


class _Words(dict):
    """Word to its ids as little-endian unsigned 32-bit integers; a missing word is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


class Encoder:
    """``encode(text)`` gives the ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spaced = self.library.normalizer is None  # words carry the space before them
        self.letters = _letters()
        self.parts = _Words(self._part)
        self.words = _Words(self._word)

    def encode(self, text: str) -> bytes:
        if self.spaced:
            if "  " in text:
                return self._whole(text)
            first, *rest = text.split(" ")
            return self._chunk(first) + b"".join(map(self.words.__getitem__, rest))
        if CONTROL.search(text):
            return self._whole(text)
        if "<|" not in text and "Σ" not in text and "İ" not in text:
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split()))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return self._chunk(" " + word if self.spaced else word)

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not SIMPLE.fullmatch(chunk):
            return self._whole(chunk)
        cut = BYTE_CUT.findall(chunk) if self.spaced else WORD_CUT.findall(chunk.lower())
        return b"".join(map(self.parts.__getitem__, cut))

    def _part(self, part: str) -> bytes:
        letters = "".join(map(self.letters.__getitem__, part.encode()))
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; loaded once."""
    if path not in LOADED:
        LOADED[path] = Encoder(path)
    return LOADED[path]


def path(name: str) -> str:
    """Where a public tokenizer file lies; every executor has it installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
