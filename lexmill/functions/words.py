"""Word segmentation by the Unicode word rules over the word-break table, with a class for each word.

Classes: NONE (white space and control), LETTER, NUMBER, PUNCT, SYMBOL. Web addresses, hashtags
and mentions are single words; letters without a rule of their own (ideographs, Hiragana, Thai)
stand alone; a hyphen parts words. Concatenated words give the text back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from ..resources import word_break_runs

NONE, LETTER, NUMBER, PUNCT, SYMBOL = "none", "letter", "number", "punct", "symbol"
CLASSES = (LETTER, NUMBER, PUNCT, SYMBOL)
#: Word-break properties by their numbers in the table.
PROPERTIES = "other aletter cr double_quote e_base e_base_gaz e_modifier extend extendnumlet format glue_after_zwj hebrew_letter hyphen katakana lf letter midletter midnum midnumlet newline number numeric unassigned punctuation regional_indicator single_quote symbol white_space zwj".split()


def _ranges(*properties: str) -> str:
    """The table's characters of these properties, as the inside of a character class."""
    wanted, (starts, classes) = {PROPERTIES.index(p) for p in properties}, word_break_runs()
    ends = [*starts[1:], 0x110000]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b, c in zip(starts, ends, classes) if c in wanted)


_MARK = f"[{_ranges('extend', 'format', 'zwj')}]"
_A = f"(?:[{_ranges('aletter', 'hebrew_letter')}]{_MARK}*)"
_N = f"(?:[{_ranges('numeric')}]{_MARK}*)"
_K = f"(?:[{_ranges('katakana')}]{_MARK}*)"
_X = f"(?:[{_ranges('extendnumlet')}]{_MARK}*)"
_LETTERS = f"(?:{_A}+(?:[{_ranges('midletter', 'midnumlet', 'single_quote')}]{_MARK}*{_A}+)*)"
_DIGITS = f"(?:{_N}+(?:[{_ranges('midnum', 'midnumlet', 'single_quote')}]{_MARK}*{_N}+)*)"
_BLOCK = f"(?:(?:{_LETTERS}|{_DIGITS})++|{_K}++)"
_WORD = f"(?:{_X}*{_BLOCK}(?:{_X}+{_BLOCK})*+{_X}*|{_X}+)"
_IDEO = f"(?:[{_ranges('letter')}]{_MARK}*)"
_EMOJI = f"(?:[{_ranges('regional_indicator')}]{_MARK}*){{2}}|[{_ranges('e_base', 'e_base_gaz', 'glue_after_zwj')}]{_MARK}*(?:[{_ranges('e_modifier')}]{_MARK}*|(?<=\u200d)[{_ranges('e_base_gaz', 'glue_after_zwj')}]{_MARK}*)*"
_LET = f"[{_ranges('aletter', 'hebrew_letter', 'katakana', 'letter')}]"
_TAG = f"[#@](?:[_{_LET[1:-1]}{_ranges('numeric', 'number')}]{_MARK}*)+"
_URL = r"(?:https?|ftp)://[^\s<>\"'«»‘-‟(){}\[\]]*[^\s<>\"'«»‘-‟(){}\[\].,;:!?]"
_BLANK = "\u200b\ufeff"
_PATTERN = rf"(?P<url>{_URL})|(?P<tag>(?<![\w]){_TAG})|(?P<word>{_WORD})|(?P<ideo>{_IDEO})|(?P<none>\r\n|\s+|[\x00-\x1f\x7f-\x9f{_BLANK}]+)|(?P<other>{_EMOJI}|.{_MARK}*)"
WORDS = re.compile(_PATTERN, re.DOTALL)
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
#: The same for texts of the basic plane: ranges beyond it are tried one by one for every character.
_BASIC = re.compile(re.sub(r"\\U000[1-9a-f][0-9a-f]{4}-\\U[0-9a-f]{8}|\\U0010[0-9a-f]{4}-\\U[0-9a-f]{8}", "", _PATTERN).replace("[]", "(?!)"), re.DOTALL)


def kind_of(char: str) -> str:
    """Class by the general category of a word's first character."""
    c = unicodedata.category(char)
    if c[0] in "LM":
        return LETTER
    if c[0] == "N":
        return NUMBER
    if c[0] == "P":
        return SYMBOL if char in "#%&@" else PUNCT
    return SYMBOL if c[0] == "S" else NONE


def scan(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, class) of every word, white space included."""
    for m in (WORDS if _ASTRAL.search(text) else _BASIC).finditer(text):
        group = m.lastgroup
        if group in ("none",):
            kind = NONE
        elif group in ("url", "ideo"):
            kind = LETTER
        elif group == "tag":
            kind = SYMBOL
        else:
            first = text[m.start()]
            kind = kind_of(first) if first != "_" or group == "other" else next((kind_of(c) for c in m[0] if c != "_"), PUNCT)
        yield m.start(), m.end(), kind


#: The same words without white space and without classes, for counting: a plain findall. ASCII
#: texts take the standard module, which is faster and needs no marks or ideographs.
_ASCII_WORD = r"(?:_*(?:[A-Za-z]+(?:[.:'][A-Za-z]+)*|[0-9]+(?:[.,;'][0-9]+)*))+_*|_+"
_ASCII = re.compile(rf"(?:https?|ftp)://[^\s<>\"'(){{}}\[\]]*[^\s<>\"'(){{}}\[\].,;:!?]|(?<!\w)[#@]\w+|{_ASCII_WORD}|[^\s\x00-\x1f\x7f]", re.ASCII)
_FLAT = re.compile(rf"{_URL}|(?<![\w]){_TAG}|{_WORD}|{_IDEO}|(?![\s\x00-\x1f\x7f-\x9f{_BLANK}])(?:{_EMOJI}|.{_MARK}*)", re.DOTALL)


def flat(text: str) -> list[str]:
    """The words of ``scan`` whose class isn't NONE by way of their pattern, as strings."""
    return (_ASCII if text.isascii() else _FLAT).findall(text)


def class_of(word: str) -> str:
    """Class of a single word as ``scan`` gives it."""
    first = next(scan(word), (0, 0, NONE))
    return first[2] if first[1] == len(word) else kind_of(word[0])
