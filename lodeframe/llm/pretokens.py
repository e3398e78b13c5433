"""Splitting texts as the tokenizers library does, for characters on which both surely agree.

A text of ``SAFE`` characters only is split here by a compiled pattern; any other text, and any text with a special
token's string, goes through the library as a whole. So the results are the library's for every text.
"""

from __future__ import annotations

import re
import unicodedata

#: Code points whose classes, cases and normal forms no Unicode version has changed: tab, line ends, ASCII, Latin-1
#: without controls and the soft hyphen, Latin Extended-A without the dotted I, and common punctuation.
SAFE_POINTS = (
    [0x09, 0x0A, 0x0D]
    + list(range(0x20, 0x7F))
    + [c for c in range(0xA0, 0x180) if c not in (0xAD, 0x130)]
    + list(range(0x2010, 0x2028))
    + list(range(0x2030, 0x205F))
    + [0x20AC, 0x2122]
)


def character_class(keep) -> str:
    return "".join(f"\\u{c:04x}" for c in SAFE_POINTS if keep(unicodedata.category(chr(c)), chr(c)))


LETTERS = character_class(lambda kind, c: kind[0] == "L")
NUMBERS = character_class(lambda kind, c: kind[0] == "N")
BLANKS = character_class(lambda kind, c: kind[0] == "Z" or c in "\t\n\r")
OTHERS = character_class(lambda kind, c: kind[0] not in "LNZ" and c not in "\t\n\r")

SAFE = re.compile(f"[{LETTERS}{NUMBERS}{BLANKS}{OTHERS}]*")
#: The parts that byte-level BPE encodes each by itself.
BYTE_PARTS = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[{OTHERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
#: The parts that BPE with word ends encodes, of a text in lower case; white space between them is dropped.
WORD_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[{OTHERS}]+")


def is_safe(text: str, special: tuple[str, ...]) -> bool:
    return SAFE.fullmatch(text) is not None and not any(s in text for s in special)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable ones stand for themselves, the others, in order, for
    code points from 256."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def in_byte_letters(part: str) -> str:
    """A part as the model of the tokenizer takes it; much faster than the library's whole way for each part."""
    return part.encode().decode("latin-1").translate(BYTE_LETTERS)


def special_strings(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
