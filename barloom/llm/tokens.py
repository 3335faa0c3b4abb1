"""Encoding whole texts with a public tokenizer inside Python tasks."""

from __future__ import annotations

import re
from functools import lru_cache
from struct import pack

from tokenizers import Tokenizer

#: A letter or digit of ASCII, then ASCII marks to the end: the marks are pieces of their own.
_TAIL = re.compile(rb"(?<=[0-9a-z])[!-/:-@\[-`{-~]+\Z")
#: What keeps a word whole as it is: the tokenizer's special tokens, and marks that may combine.
_GUARD = re.compile(rb"<\||[\xcc\xcd]")


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where the tokenizers' package keeps a file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker: its cache serves all tasks that the worker runs."""
    return WordEncoder(path)


def parts_of(word: bytes) -> tuple[bytes, bytes]:
    """(stem, tail) of a word, whose ids are the stem's, then the tail's (which may be empty).

    The stem is lower-cased as the tokenizer would; the tail is the run of ASCII marks after the word's last
    letter or digit.
    """
    if word.isalpha() and word.islower():  # ASCII letters alone
        return word, b""
    if _GUARD.search(word):
        return word, b""
    low = word.lower()
    m = _TAIL.search(low)
    return (low[: m.start()], m[0]) if m else (low, b"")


#: Stems that are one pre-token of lower-case Latin-1 letters in their composed form: the model takes them as they are.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else one past 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


_SHOWN = _byte_letters()


class WordEncoder:
    """Encodes texts word by word, most words from a table of those it has met.

    The tokenizer lower-cases, drops white space and never forms pieces across it, so a text's ids are its
    words' ids in order; and where ASCII marks follow a word's last letter or digit, the word's ids are its
    stem's and the marks'. A full table becomes the old one, from which words that are met again move to the
    new one, so that two tables bound memory and frequent words are never encoded twice.
    """

    MOST = 400_000

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.model = self.tok.model
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.packed = [pack("<H", k) for k in range(self.tok.get_vocab_size())]

    def part(self, p: bytes) -> bytes:
        """The ids of a stem or tail as little-endian unsigned 16-bit integers."""
        if _LETTERS.fullmatch(p):
            ids = [t.id for t in self.model.tokenize(p.decode("ascii") if p.isascii() else "".join([_SHOWN[b] for b in p]))]
        else:
            ids = self.tok.encode(p.decode(), add_special_tokens=False).ids
        packed = self.packed
        return b"".join([packed[k] for k in ids])

    def _met(self, w: bytes) -> bytes | None:
        ids = self.known.get(w)
        return self.old.get(w) if ids is None else ids

    def word(self, w: bytes) -> bytes:
        """The ids of a word (UTF-8, without ASCII white space)."""
        stem, tail = parts_of(w)
        ids = None if stem is w else self._met(stem)
        if ids is None:
            ids = self.part(stem)
        if tail:
            end = self._met(tail)
            if end is None:
                self.known[tail] = end = self.part(tail)
            ids += end
        return ids

    def encode(self, text: bytes) -> bytes:
        """The ids of a text."""
        if len(self.known) > self.MOST:
            self.known, self.old = {}, self.known
        words, known, old = text.split(), self.known, self.old
        out = list(map(known.get, words))
        k = -1
        for _ in range(out.count(None)):
            k = out.index(None, k + 1)
            w = words[k]
            ids = known.get(w)
            if ids is None:
                ids = old.get(w)
                known[w] = ids = self.word(w) if ids is None else ids
            out[k] = ids
        return b"".join(out)
