"""Cutting a text into blocks that a byte-level tokenizer treats independently.

The tokenizer's pattern never puts a space after a non-space character into one pre-token, and what
it does from such a space on depends only on what follows. A block is a run of white space with the
non-space run behind it; every block starts in the same tokenizer state.
"""

from __future__ import annotations

import re

import regex

#: The published pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_plain_words = regex.compile(PATTERN).findall
#: Characters whose class is the same in all Unicode versions that the libraries follow.
settled = re.compile("[\\x00-\u052f\u2010-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*").fullmatch
#: Any space that is not directly between two non-space characters, by either library's notion of space.
UNEVEN = re.compile(r"\s [^\s]| \s|^ | $|\s$|^\s")
_general = re.compile(r"(?<=\S)(?= )").split


def words_of(block: str, library) -> list[str]:
    """Pre-tokens of ``block``. ``library()`` is the tokenizer, asked where Unicode versions differ."""
    if settled(block):
        return _plain_words(block)
    return [block[a:b] for _, (a, b) in library().pre_tokenizer.pre_tokenize_str(block)]


def blocks(text: str) -> list[str]:
    """Blocks of ``text``: joined they give the text again."""
    return _general(text)


def spaced(text: str) -> list[str] | None:
    """The parts between single spaces, or None if some space is not between two non-space characters."""
    if UNEVEN.search(text):
        return None
    return text.split(" ")


def segments(text: str, special: list[str]) -> tuple[list[str], list[str]]:
    """``text`` between occurrences of special strings, and those strings in order."""
    if not any(s in text for s in special):
        return [text], []
    parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text)
    return parts[::2], parts[1::2]
