"""Text maps from token to type: case folding, compatibility forms, ignorables, quotes."""

from __future__ import annotations

import re
import unicodedata

_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_SINGLE = "‘’‚‛‟"


def normalize(text: str, case: bool = True, compat: bool = True, quote: bool = True, ignorable: bool = True) -> str:
    """Apply the chosen maps; the result is in NFC (NFKC with ``compat``)."""
    if text.isascii():
        return text.lower() if case else text
    form = "NFKD" if compat else "NFD"
    text = unicodedata.normalize(form, text)
    if case:
        text = unicodedata.normalize(form, text.casefold())
    if ignorable:
        text = _IGNORABLE.sub("", text)
    if quote:
        for mark in _SINGLE:
            text = text.replace(mark, "'")
    return unicodedata.normalize("NFC", text)
