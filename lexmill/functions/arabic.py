"""The published Snowball algorithm for Arabic: normalise, strip suffixes, strip prefixes, normalise the rest."""

from __future__ import annotations

import re
import unicodedata

_MARKS = re.compile("[ً-ِّْـ]")
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")
_FORMS = re.compile("[ﺀ-ﻼ]")


def _normalized(w: str) -> str:
    """Marks and stretching dropped, digits and presentation forms made plain."""
    return _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), _MARKS.sub("", w)).translate(_DIGITS)


def _suffix(w: str, *groups: tuple[int, str]) -> str | None:
    """The word without its longest suffix, if it is as long as that suffix's group asks for."""
    found = [(s, least) for least, words in groups for s in words.split() if w.endswith(s)]
    if not found:
        return None
    s, least = max(found, key=lambda x: len(x[0]))
    return w[: -len(s)] if len(w) >= least else None


def _prefix(w: str, *groups: tuple[int, dict[str, str]]) -> str | None:
    """The word with its longest prefix replaced, if it is as long as that prefix's group asks for."""
    found = [(p, to, least) for least, words in groups for p, to in words.items() if w.startswith(p)]
    if not found:
        return None
    p, to, least = max(found, key=lambda x: len(x[0]))
    return to + w[len(p) :] if len(w) >= least else None


def _verb_1(w):
    return _suffix(w, (4, "ه ك"), (5, "ني نا ها هم هن كم كن"), (6, "هما كما كمو"))


def _verb_2a(w):
    return _suffix(w, (4, "ت ا ن ي"), (5, "نا تا تن"), (6, "ان ون ين تما"))


def _verb_2b(w):
    return _suffix(w, (5, "وا تم"))


def _verb_2c(w):
    return _suffix(w, (4, "و"), (6, "تمو"))


def _noun_1a(w):
    return _suffix(w, (4, "ي ك ه"), (5, "نا كم ها هن هم"), (6, "كما هما"))


def _noun_2a(w):
    return _suffix(w, (5, "ا ي و"))


def _noun_2b(w):
    return _suffix(w, (5, "ات"))


def _noun_2c1(w):
    return _suffix(w, (4, "ت"))


def _first(w: str, *steps) -> str | None:
    return next((x for x in (step(w) for step in steps) if x is not None), None)


def _as_verb(w: str) -> str | None:
    x = w
    cut = _verb_1(x)
    if cut is not None:
        while cut is not None:  # at least once
            x, cut = cut, _verb_1(cut)
        y = _first(x, _verb_2a, _verb_2c)
        return y if y is not None else x if x else None
    return _first(w, _verb_2b, _verb_2a)


def _as_noun(w: str, definite: bool) -> tuple[str, bool]:
    """The word after its noun endings and whether the last step held; what failed steps cut stays cut."""
    inner = (_noun_2a, _noun_2b, _noun_2c1)
    x = _suffix(w, (4, "ة"))
    if x is None and not definite and (y := _noun_1a(w)) is not None:
        x = _first(y, *inner)
        x = y if x is None else x
    if x is None and (y := _suffix(w, (6, "ن"))) is not None:
        w, x = y, _first(y, *inner)
    if x is None and not definite:
        x = _noun_2a(w)
    if x is None:
        x = _noun_2b(w)
    w = w if x is None else x
    x = _suffix(w, (3, "ي"))
    return (w, False) if x is None else (x, True)


def _unprefixed(w: str, noun: bool, verb: bool) -> str:
    x = _prefix(w, (4, {"أأ": "أ", "أآ": "آ", "أؤ": "أ", "أا": "ا", "أإ": "إ"}))
    w = w if x is None else x
    if not w.startswith(("فا", "وا")):
        x = _prefix(w, (4, {"ف": "", "و": ""}))
        w = w if x is None else x
    x = _prefix(w, (6, {"بال": "", "كال": ""}), (5, {"ال": "", "لل": ""}))
    if x is None and noun and not w.startswith("با"):
        x = _prefix(w, (4, {"ب": "", "بب": "ب", "كك": "ك"}))
    if x is None and verb:
        y = _prefix(w, (5, {"سي": "ي", "ست": "ت", "سن": "ن", "سأ": "أ"}))
        w = w if y is None else y
        x = _prefix(w, (5, {"يست": "است", "نست": "است", "تست": "است"}))
    return w if x is None else x


def arabic(word: str) -> str:
    verb, definite = True, False
    if p := next((p for p in ("بال", "كال", "لل", "ال") if word.startswith(p)), None):
        definite = len(word) > len(p) + 1
        verb = not definite
    w = _normalized(word)
    x = _as_verb(w) if verb else None
    if x is None:
        w, done = _as_noun(w, definite)
        x = w if done or not w.endswith("ى") else w[:-1] + "ي"
    w = _unprefixed(x, True, verb)
    if w:
        w = w[:-1] + {"أ": "ء", "إ": "ء", "آ": "ء", "ؤ": "ء", "ئ": "ء"}.get(w[-1], w[-1])
    return w.translate(str.maketrans("أإآؤئ", "اااوي"))
