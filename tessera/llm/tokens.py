"""Token ids of whole texts, each distinct piece of a word encoded once.

The vocabulary's own rules (NFC, lower case, its pattern) cut a text into pieces that its merges never cross, so a text's
ids are its pieces' ids in order and an encoder needs to see a piece only once; a bounded memo keeps what it has seen.

The rules are applied here only to characters on which every version of the Unicode tables agrees (``KNOWN``); a word with
any other character, or with a special mark, goes through the library as a whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: A memo is emptied when it holds so many words or pieces of words; longer ones than so many characters are not kept.
MEMO_WORDS, MEMO_PIECES, MEMO_CHARS = 300_000, 400_000, 100
#: Longer texts are split part by part, so that their words never stand in memory at once.
PART_CHARS = 4_000_000
_PART = re.compile(r"(?<=\S) (?=\S)")

#: Classes of characters that keep their meaning in all Unicode versions and are their own normal form. Letters: Latin
#: (without the dotted capital I, whose lower case is two characters), Greek and Cyrillic basics (without the capital
#: sigma, whose lower case depends on its place), kana, common ideographs, Hangul syllables.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-žΑ-ΡΤ-Ωα-ωА-яёЁあ-んア-ヺ一-龥가-힣"
DIGITS = "0-9²³¹¼-¾"
SIGNS = "\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e\xa1-\xa9\xab-\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf×÷‐-‧‰-⁅、-。「-】"
SPACES = "\x20\t\n\r\x0b\x0c\x85\xa0　"
_KNOWN_TEXT = re.compile(f"[{LETTERS}{DIGITS}{SIGNS}{SPACES}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[{SIGNS}]+")


def default_vocabulary() -> str:
    """The public word-level BPE vocabulary of the box; any other file's path can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo(dict):
    """text -> its ids as the bytes of 32-bit numbers; ``encode`` gives those of a text that is not kept."""

    def __init__(self, encode: Callable[[str | bytes], bytes], limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, text: str | bytes) -> bytes:
        ids = self.encode(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[text] = ids
        return ids


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def parts(text: str) -> Iterator[str]:
    """A long text in parts that begin at single spaces between words; each later part keeps that space."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = _PART.search(text, at + PART_CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where visible, else one from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b if b in visible else next(rest)) for b in range(256)]


class LibraryEncoder:
    """``text -> ids`` by the tokenizers library with add_special_tokens=False; ``end_id`` is appended where given."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end = b"" if end_id is None else as_bytes([end_id])
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.letters, self.merge = dict(enumerate(byte_letters())), self.library.model.tokenize
        self.pieces, self.words = Memo(self.piece, MEMO_PIECES), Memo(self.word, MEMO_WORDS)

    def whole(self, text: str) -> bytes:
        return as_bytes(self.library.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        return as_bytes([t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))])

    def known(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def word(self, word: str) -> bytes:
        return self.known(word) if _KNOWN_TEXT.fullmatch(word) and not self.special.search(word) else self.whole(word)

    def __call__(self, text: str) -> np.ndarray:
        if _KNOWN_TEXT.fullmatch(text) and not self.special.search(text):
            ids = self.known(text) if len(text) <= PART_CHARS else b"".join(map(self.known, parts(text)))
        elif any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the library
            ids = self.whole(text)
        else:
            ids = b"".join(b"".join(map(self.words.__getitem__, part.split())) for part in parts(text))
        return np.frombuffer(ids + self.end, "<u4")


@lru_cache(2)
def encoder(path: str, end_id: int | None) -> LibraryEncoder:
    return LibraryEncoder(path, end_id)
