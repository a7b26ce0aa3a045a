"""Sentence segmentation by the Unicode rules, with optional abbreviation lists.

``segment`` is a state machine over sentence-break classes. Extend and Format characters join
what precedes them. ``crlf_as_space`` treats CR and LF as spaces. ``Suppressor`` glues a sentence
that ends in a full stop to the next one when an abbreviation stands at its end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from ..resources import sentence_break_runs

OTHER, ATERM, CR, CLOSE, EXTEND, FORMAT, LF, LOWER, NUMERIC, OLETTER, SCONTINUE, STERM, SEP, SP, UPPER = range(15)
END = -1
KINDS = {END: "none", SEP: "parasep", ATERM: "aterm", STERM: "sterm"}


@lru_cache(1 << 16)
def break_class(char: str) -> int:
    starts, classes = sentence_break_runs()
    return classes[bisect_right(starts, ord(char)) - 1]


@lru_cache(1)
def _table() -> np.ndarray:
    starts, classes = sentence_break_runs()
    return np.repeat(np.array(classes, np.uint8), np.diff([*starts, 0x110000]))


def _classes(text: str) -> bytes:
    return _table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes()


_STOPS = re.compile(b"[" + re.escape(bytes((CR, LF, SEP, ATERM, STERM))) + b"]")


class _Cursor:
    """Next unconsumed class; ``take`` consumes it with the Extend and Format that follow."""

    def __init__(self, text: str, crlf: bool):
        self.cls, self.at, self.crlf, self.n = _classes(text), 0, crlf, len(text)

    @property
    def now(self) -> int:
        return self.cls[self.at] if self.at < self.n else END

    def take(self) -> int:
        c = self.now
        self.at += 1
        if c != SEP and (c not in (CR, LF) or self.crlf):
            while self.at < self.n and self.cls[self.at] in (EXTEND, FORMAT):
                self.at += 1
        return c

    def skip(self) -> None:
        """On to the last character before the next that may end a sentence, with the marks that follow it: what lies between ends none."""
        stop = _STOPS.search(self.cls, self.at)
        at = (stop.start() if stop else self.n) - 1
        while at > self.at and self.cls[at] in (EXTEND, FORMAT):
            at -= 1
        self.at = max(self.at, at)

    def paragraph(self) -> bool:
        """Consume a line or paragraph end; true if it breaks."""
        c = self.take()
        if self.crlf and c != SEP:
            return False
        if c == CR and self.now == LF:
            self.take()
        return True

    def lower_follows(self) -> bool:
        """After a full stop: is the next letter or stop a lower-case letter?"""
        for k in range(self.at + 1, self.n):
            c = self.cls[k]
            if c == LOWER:
                return True
            if c in (OLETTER, UPPER, SEP, STERM, ATERM) or c in (CR, LF) and not self.crlf:
                return False
        return False


def _sentence(c: _Cursor) -> int:
    """Consume one sentence; its break class."""
    lines = (CR, LF, SEP)
    while True:
        c.skip()
        x = c.now
        if x == END:
            return END
        if x in lines:
            if c.paragraph():
                return SEP
            continue
        c.take()
        if x in (UPPER, LOWER):
            while True:
                # a full stop between a letter and a capital ends nothing
                if c.now in (UPPER, LOWER):
                    c.take()
                elif c.now == ATERM:
                    c.take()
                    if c.now == UPPER:
                        c.take()
                        continue
                    x = ATERM
                    break
                else:
                    x = OTHER
                    break
        while x in (ATERM, STERM):
            stop, x = x, OTHER
            if stop == ATERM and c.now == NUMERIC:
                c.take()
                break
            while c.now == CLOSE:
                c.take()
            broke = False
            while c.now == SP or c.now in lines and c.crlf and c.now != SEP:
                c.take()
            if c.now in lines:
                broke = c.paragraph()
            if broke:
                return SEP
            nxt = c.now
            if nxt == SCONTINUE:
                c.take()
            elif nxt in (STERM, ATERM):
                x = c.take()
            elif stop == STERM:
                return STERM
            elif nxt == LOWER:
                break
            elif nxt in (OLETTER, UPPER) or not c.lower_follows():
                return ATERM


def segment(text: str, crlf_as_space: bool = False) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the sentences; an empty text is one empty sentence."""
    c = _Cursor(text, crlf_as_space)
    if not text:
        yield 0, 0, END
    while c.at < c.n:
        start = c.at
        kind = _sentence(c)
        yield start, c.at, kind


FULL, PARTIAL = 2, 1


class Suppressor:
    """Tries of abbreviations: reversed ones, and whole ones for those with inner spaces."""

    def __init__(self, abbreviations: Iterable[str] = ()):
        self.back: dict = {}
        self.forward: dict = {}
        for p in abbreviations:
            self._add(self.back, p[::-1], FULL)
            inner = [k for k in range(len(p) - 1) if p[k] == "." and p[k + 1] == " "]
            for k in inner:
                self._add(self.back, p[k::-1], PARTIAL)
            if inner:
                self._add(self.forward, p, FULL)

    @staticmethod
    def _norm(text: str) -> str:
        keep = [(c, break_class(c)) for c in text]
        return "".join(" " if k == SP else "." if k == ATERM else c for c, k in keep if k not in (EXTEND, FORMAT))

    def _add(self, trie: dict, path: str, mark: int) -> None:
        for c in self._norm(path):
            trie = trie.setdefault(c, {})
        trie[""] = max(trie.get("", 0), mark)

    def _bound(self, k: int, crlf: bool) -> bool:
        return k in (SEP, CLOSE, STERM) or k in (CR, LF) and not crlf

    def _ahead(self, text: str, at: int, crlf: bool) -> bool:
        node = self.forward
        for i in range(at, len(text)):
            c = text[i]
            k = break_class(c)
            if k in (EXTEND, FORMAT):
                continue
            edge = self._bound(k, crlf)
            c = " " if k == SP or k in (CR, LF) and crlf else "." if k == ATERM else c
            if node.get("") == FULL and (edge or c in " ."):
                return True
            if edge or c not in node:
                return False
            node = node[c]
        return node.get("") == FULL

    def ends_in(self, text: str, end: int, crlf: bool) -> bool:
        """Does an abbreviation stand at the end of ``text[:end]``?"""
        blank = lambda k: k in (SP, EXTEND, FORMAT) or k in (CR, LF) and crlf
        at = end
        while at and blank(break_class(text[at - 1])):
            at -= 1
        node = self.back
        while True:
            k = break_class(text[at - 1]) if at else END
            if k in (EXTEND, FORMAT):
                at -= 1
                continue
            edge = not at or self._bound(k, crlf)
            c = "" if edge else " " if k == SP or k in (CR, LF) else "." if k == ATERM else text[at - 1]
            if edge or c in " .":
                mark = node.get("", 0)
                if mark == FULL or mark == PARTIAL and self._ahead(text, at, crlf):
                    return True
            if edge or c not in node:
                return False
            node, at = node[c], at - 1


def sentences(text: str, crlf_as_space: bool = False, suppressor: Suppressor | None = None) -> Iterator[tuple[int, int, int]]:
    """Like ``segment``, with suppressed breaks glued."""
    open_ = None
    for start, end, kind in segment(text, crlf_as_space):
        first = start if open_ is None else open_
        if suppressor and kind == ATERM and end < len(text) and suppressor.ends_in(text, end, crlf_as_space):
            open_ = first
            continue
        yield first, end, kind
        open_ = None
