"""Language data: stop word lists, abbreviations that don't end a sentence, sentence- and word-break classes (Unicode 10)."""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from pathlib import Path

_HERE = Path(__file__).parent


@lru_cache(None)
def _lists(table: str) -> dict[str, list[str]]:
    return json.loads((_HERE / f"{table}.json").read_text("utf-8"))


def stopword_names() -> list[str]:
    return sorted(_lists("stopwords"))


def stopwords(language: str) -> list[str]:
    """Words of the list; an unknown language has none."""
    return _lists("stopwords").get(language, [])


def suppression_names() -> list[str]:
    return sorted(_lists("suppressions"))


def suppressions(language: str) -> list[str]:
    return _lists("suppressions").get(language, [])


def _runs(table: str) -> tuple[list[int], list[int]]:
    """First code points and classes of the runs of equal class."""
    starts, classes, at = [], [], 0
    for item in (_HERE / f"{table}.txt").read_text().split():
        step, cls = item.split(".")
        at += int(step, 16)
        starts.append(at)
        classes.append(int(cls))
    return starts, classes


@lru_cache(None)
def sentence_break_runs() -> tuple[list[int], list[int]]:
    return _runs("sentence_break")


@lru_cache(None)
def word_break_runs() -> tuple[list[int], list[int]]:
    return _runs("word_break")


def word_break(char: str) -> int:
    """Number of a character's word-break property."""
    starts, classes = word_break_runs()
    return classes[bisect_right(starts, ord(char)) - 1]
