"""Suffix stripping by the published English (Porter 2) and Porter algorithms; other languages are in ``snowball``.

``stemmer(name)`` gives a callable; a user's own callable may return None for "no stem".
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from . import snowball

_V = "aeiouy"


def _region(w: str, at: int = 0) -> int:
    m = re.compile(f"[{_V}][^{_V}]").search(w, at)
    return m.end() if m else len(w)


_EXCEPT = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_STOP1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


def english(word: str) -> str:
    w = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if w in _EXCEPT:
        return _EXCEPT[w]
    if len(w) <= 2:
        return w
    w = re.sub(f"(?:^|(?<=[{_V}]))y", "Y", w.removeprefix("'"))
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else _region(w)
    r2 = _region(w, r1)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _STOP1A:
        return w.lower()
    m = re.search("(eedly|eed|edly|ed|ingly|ing)$", w)
    if m:
        if m[0].startswith("ee"):
            if m.start() >= r1:
                w = w[: m.start()] + "ee"
        elif re.search(f"[{_V}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if re.search(f".[^{_V}][yY]$", w):
        w = w[:-1] + "i"
    for suffix, to in _STEP2.items():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + to
            break
    else:
        if w.endswith("ogi"):
            w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for suffix, to in _STEP3.items():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_P2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_P3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}


def porter(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    form = lambda s: re.sub(f"(?<=[^{_V[:5]}])y|(?<![a-z])y", lambda m: "Y" if m.start() == 0 else "y", s)
    w = re.sub("(?:^|(?<=[aeiouy]))y", "Y", form(w))
    measure = lambda s: len(re.findall("[aeiouy]+[^aeiouy]+", s))
    vowel = lambda s: re.search("[aeiouy]", s)
    cvc = lambda s: re.search("[^aeiouy][aeiouy][^aeiouywxY]$", s)
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    elif m := re.search("(ed|ing)$", w):
        if vowel(w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"([^aeiouylsz])\1$", w):
                w = w[:-1]
            elif measure(w) == 1 and cvc(w):
                w += "e"
    if w[-1:] in ("y", "Y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_P2, _P3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                if measure(w[: -len(suffix)]):
                    w = w[: -len(suffix)] + table[suffix]
                break
    for suffix in sorted([*_STEP4, "ou", "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            if measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(suffix)]
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w.lower()


ALGORITHMS: dict[str, Callable[[str], str | None]] = {"english": english, "porter": porter, **snowball.ALGORITHMS}
ALIASES = {"en": "english", "eng": "english", **snowball.ALIASES}


def stemmer_names() -> list[str]:
    return sorted(ALGORITHMS)


def stemmer(which: str | Callable[[str], str | None]) -> Callable[[str], str | None]:
    """The algorithm of a name or alias, memoised; a callable is taken as it is."""
    if callable(which):
        return which
    key = ALIASES.get(which, which)
    if key not in ALGORITHMS:
        raise ValueError(f"no stemmer {which!r}; there are {', '.join(stemmer_names())}")
    return lru_cache(1 << 18)(ALGORITHMS[key])
