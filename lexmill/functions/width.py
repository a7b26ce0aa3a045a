"""Display width of text in fixed-width cells."""

from __future__ import annotations

import unicodedata
from functools import lru_cache


@lru_cache(1 << 16)
def char_width(char: str) -> int:
    """0 for marks, format and control characters, 2 for wide ones and emoji, else 1."""
    if unicodedata.category(char) in ("Mn", "Me", "Cf", "Cc", "Cs"):
        return 0
    return 2 if unicodedata.east_asian_width(char) in ("W", "F") else 1


def width(text: str) -> int:
    return len(text) if text.isascii() and text.isprintable() else sum(map(char_width, text))
