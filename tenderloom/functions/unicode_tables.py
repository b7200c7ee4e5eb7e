"""Character tables for compatibility decomposition, derived by rule from ``unicodedata``.

Dropping combining marks after NFKD acts on one character at a time, so the
whole mapping splits into characters that become one character, characters that
vanish, and characters that become several.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

HANGUL = range(0xAC00, 0xD7A4)
LATIN_LIMIT = 0x250
LATIN_MARKS = range(0x300, 0x370)


class FoldTable(NamedTuple):
    source: str
    target: str
    expansions: dict[str, str]


def _folded(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


def _is_latin(code: int) -> bool:
    return code < LATIN_LIMIT or code in LATIN_MARKS


@lru_cache(maxsize=None)
def fold_table(latin_only: bool) -> FoldTable:
    """Characters folded by ``translate`` (vanishing ones last) and those that expand."""
    singles: dict[str, str] = {}
    vanishing: list[str] = []
    expansions: dict[str, str] = {}
    for code in range(0x80, 0x110000):
        if code in HANGUL or 0xD800 <= code <= 0xDFFF or (latin_only and not _is_latin(code)):
            continue
        ch = chr(code)
        if not unicodedata.decomposition(ch) and not unicodedata.combining(ch):
            continue
        out = _folded(ch)
        if not out:
            vanishing.append(ch)
        elif len(out) > 1:
            expansions[ch] = out
        elif out != ch:
            singles[ch] = out
    return FoldTable("".join(singles) + "".join(vanishing), "".join(singles.values()), expansions)


def char_class(codes: list[int]) -> str:
    """Body of a regex character class covering ``codes``, as ranges."""
    runs: list[list[int]] = []
    for code in sorted(codes):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{lo:x}}}" + (f"-\\x{{{hi:x}}}" if hi > lo else "") for lo, hi in runs)


@lru_cache(maxsize=None)
def expanding_class() -> str:
    return "[" + char_class([ord(c) for c in fold_table(False).expansions] + list(HANGUL)) + "]"


@lru_cache(maxsize=None)
def latin_only_regex() -> str:
    """Matches texts made only of characters the Latin table folds by itself."""
    expanding = {ord(c) for c in fold_table(True).expansions}
    simple = [c for c in [*range(LATIN_LIMIT), *LATIN_MARKS] if c not in expanding]
    return rf"\A[{char_class(simple)}]*+\z"
