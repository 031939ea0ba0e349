"""Byte-level BPE shared by the token operators.

Text can be cut before its spaces, where no match of the pre-token pattern crosses, so that a word met before
costs one dictionary lookup. Texts where white space follows a space are not cut.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import cached_property, lru_cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

#: Entries that a worker's memo holds at most; then it starts anew. Longer pieces are never kept.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 64

_crossed = re.compile(r" \s").search
_beyond = re.compile("[\u0378-\U0010ffff]").search  # U+0378 is the first code point that no character has


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary file stands for: printable Latin-1 bytes stand for
    themselves, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load(path: str) -> tiktoken.Encoding:
    """The encoder of a tokenizers .json (with its special tokens) or of a .tiktoken rank file (without any)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): n for token, n in held["model"]["vocab"].items() if token not in special}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(n) for token, n in (line.split() for line in f)}
        special = {}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=1)
def late_letters() -> frozenset[str]:
    """Characters that the regex module may know as letters or numbers while older Unicode tables do not."""
    return frozenset(c for c in map(chr, range(0x378, 0x110000)) if unicodedata.category(c) == "Cn")


def pieces(text: str) -> list[str] | None:
    """text cut before its spaces; None where a cut could part one pre-token."""
    if _crossed(text) or text.endswith(" "):
        return None
    return text.split(" ")


_find = regex.compile(public_tokenizers.PATTERN).findall


@lru_cache(maxsize=1)
def _older():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


def pre_tokens(text: str) -> list[str]:
    """The matches of the pattern, with the Unicode tables of the tokenizer libraries."""
    if text.isascii() or not _beyond(text) or late_letters().isdisjoint(text):
        return _find(text)
    return [text[a:b] for _, (a, b) in _older().pre_tokenize_str(text)]


_MARKS = frozenset(",.;:!?)\"")


def short_pre_tokens(text: str) -> list[str]:
    """pre_tokens() of a piece of a few words at most. Letters alone, or before one mark, need no pattern: letters
    below the code points in which tables differ are letters to all of them."""
    own = text[1:] if text[:1] == " " else text
    if own.isalpha():
        if text.isascii() or not _beyond(text):
            return [text]
    elif own[-1:] in _MARKS and own[:-1].isalpha() and (text.isascii() or not _beyond(text)):
        return [text[:-1], text[-1]]
    return pre_tokens(text)


class Memo(dict):
    """make(piece) for each piece, kept for the common ones."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = value
        return value


#: The pattern's look-ahead, which keeps it from the fast matcher. It tells apart only white space before white space: a
#: single one is a match either way.
AHEAD = r"|\s+(?!\S)"
_run = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"


def runs(texts: pa.Array) -> list[bool | None]:
    """Whether white space follows white space in each text."""
    return pc.match_substring_regex(texts, _run).to_pylist()


class Encoder:
    """Whole texts to token ids, an array of unsigned 32-bit integers; special strings as the file's default."""

    def __init__(self, path: str):
        self.bpe = load(path)

    @cached_property
    def plain(self) -> tiktoken.Encoding:
        """The same ids for texts without runs of white space, sooner."""
        return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN.replace(AHEAD, ""), mergeable_ranks=self.bpe._mergeable_ranks, special_tokens=self.bpe._special_tokens)

    def __call__(self, text: str, run: bool = True):
        """run: whether white space may follow white space."""
        return (self.bpe if run else self.plain).encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and file, kept across tasks."""
    return Encoder(path)
