"""Splitting texts into pre-tokens: a fast form for Latin texts, the full Unicode form for the rest."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Below this code point letters and numbers are listed for ``re``, which is faster than ``regex``.
LATIN_END = 0x250
_LATIN = [chr(c) for c in range(LATIN_END)]
LETTERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
#: White space as the Unicode property has it; ``re`` would add U+001C to U+001F.
SPACES = "\\t-\\r \\x85\\xa0"
_beyond_latin = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]")


class Splitter:
    """``findall`` of a pattern written with ``\\p{L}``, ``\\p{N}`` and ``\\s``/``\\S``."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        latin = pattern.replace("[\\p{L}]", f"[{LETTERS}]").replace("[\\p{N}]", f"[{NUMBERS}]")
        latin = latin.replace("[^\\s\\p{L}\\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]")
        latin = latin.replace("\\p{L}", f"[{LETTERS}]").replace("\\p{N}", f"[{NUMBERS}]")
        latin = latin.replace("\\S", f"[^{SPACES}]").replace("\\s", f"[{SPACES}]")
        self.latin = re.compile(latin)

    def __call__(self, text: str) -> list[str]:
        split = self.full if _beyond_latin.search(text) else self.latin
        return split.findall(text)


def is_latin(text: str) -> bool:
    return not _beyond_latin.search(text)
