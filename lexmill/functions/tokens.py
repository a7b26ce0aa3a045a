"""The token filter: normalise, combine, stem, drop, join. One pass over the words of a text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from .normalize import normalize
from .stem import stemmer
from .words import CLASSES, LETTER, NONE, NUMBER, class_of, flat, kind_of, scan

#: Words whose types a filter remembers.
MEMO = 1 << 16


@dataclass(frozen=True)
class TokenSpec:
    """What the filter does; sequences are tuples so that a spec can be hashed and shipped.

    ``drop`` and ``drop_except`` name types (after stemming); an exception wins. ``stem_except``
    types aren't stemmed. ``combine`` rules are phrases that become one token, longest first.
    """

    case: bool = True
    compat: bool = True
    quote: bool = True
    ignorable: bool = True
    drop_classes: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    drop_except: tuple[str, ...] = ()
    combine: tuple[str, ...] = ()
    stem: str | Callable[[str], str | None] | None = None
    stem_except: tuple[str, ...] = ()
    connector: str = "_"

    def __post_init__(self):
        if bad := set(self.drop_classes) - set(CLASSES):
            raise ValueError(f"no word class {sorted(bad)}")

    def map(self, token: str) -> str:
        return normalize(token, self.case, self.compat, self.quote, self.ignorable)

    def without(self, words, stem: bool = True) -> TokenSpec:
        """Drop the words (stop words) and keep them from being stemmed."""
        from dataclasses import replace

        types = tuple(dict.fromkeys(map(self.map, words)))
        return replace(self, drop=self.drop + types, stem_except=self.stem_except + (types if stem else ()))


class _Memo(dict):
    """What a function makes of characters."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        out = self[key] = self.make(key)
        return out


def _leading(char: str) -> str | None:
    """Class of a type that begins with this character, where that decides."""
    return NUMBER if "0" <= char <= "9" else LETTER if char and unicodedata.category(char)[0] == "L" else None


_SPACE = re.compile(r"[^\S\n]")


@dataclass(eq=False)
class Filter:
    """A spec made ready; keep one per worker."""

    spec: TokenSpec
    trie: dict = field(default_factory=dict)
    memo: dict = field(default_factory=dict)
    by_word: dict = field(default_factory=dict)
    leading: dict = field(default_factory=lambda: _Memo(_leading))
    kinds: dict = field(default_factory=lambda: _Memo(kind_of))

    def __post_init__(self):
        s = self.spec
        self.type = lru_cache(1 << 14)(s.map)
        self.stem = stemmer(s.stem) if s.stem else None
        self.unstemmed, self.dropped, self.kept = set(s.stem_except), set(s.drop), set(s.drop_except)
        for rule in s.combine:
            path = [" " if k == NONE else s.map(rule.strip()[a:b]) for a, b, k in scan(rule.strip())]
            if len(path) > 1:  # a one-word rule changes nothing
                node = self.trie
                for p in path:
                    node = node.setdefault(p, {})
                node[None] = "".join(path)

    def first_class(self, type_: str) -> str:
        if k := self.leading[type_[:1]]:
            return k
        if type_ not in self.by_word:
            if len(self.by_word) >= MEMO:
                self.by_word.clear()
            self.by_word[type_] = next((k for _, _, k in scan(type_) if k != NONE), NONE)
        return self.by_word[type_]

    def drops(self, type_: str) -> bool:
        if type_ in self.kept:
            return False
        if type_ in self.dropped:
            return True
        k = self.first_class(type_)
        return k == NONE or k in self.spec.drop_classes

    def stemmed(self, type_: str) -> str | None:
        if type_ in self.unstemmed:
            return type_
        if type_.isascii() and type_.isalpha():
            return self.stem(type_) or None
        words = list(scan(type_))
        if len(words) != 1 or words[0][2] != LETTER:
            return type_
        return self.stem(type_) or None

    def _combined(self, words, types, at: int):
        """(type, words used) of the longest rule from here."""
        node, k, best = self.trie, at, None
        while k < len(words):
            if words[k][2] == NONE:
                node, k = node.get(" "), k + 1
                while k < len(words) and words[k][2] == NONE:
                    k += 1
            else:
                node, k = node.get(types[k]), k + 1
            if node is None:
                break
            if None in node:
                best = node[None], k - at
        return best

    def types(self, text: str) -> list[str]:
        """The kept types of a text in order; without combine rules one look-up per word."""
        if self.trie:
            return [x for _, _, x, _ in self.tokens(text) if x is not None]
        memo, out = self.memo, []
        for word in flat(text):
            try:
                type_ = memo[word]
            except KeyError:
                if len(memo) >= MEMO:
                    memo.clear()
                type_ = memo[word] = self.final(word)
            if type_ is not None:
                out.append(type_)
        return out

    def mapped(self, words: list[str], kinds: list[str | None]) -> tuple[list[str], list[str | None], list[str]]:
        """Types before combining, final types and classes of single words; a class that is given is kept.

        The maps work on characters and their marks and words hold no line feed, so all words are mapped as one text.
        """
        if not words:
            return [], [], []
        one = self.spec.map("\n".join(words))
        types = one.split("\n")
        if len(types) != len(words):
            types = [self.spec.map(w) for w in words]
        kind = [k or self.kinds[w[0] if w[0] != "_" else next((c for c in w if c != "_"), "_")] for w, k in zip(words, kinds)]
        if self.stem or _SPACE.search(one):
            return types, [self.finished(t) for t in types], kind
        drop = {NONE, *self.spec.drop_classes}
        if not (self.dropped or self.kept):
            final = [None if (self.leading[t[:1]] or self.first_class(t)) in drop else t for t in types]
        else:
            final = [None if self.drops(t) else t for t in types]
        return types, final, kind

    def finished(self, type_: str | None) -> str | None:
        """A type stemmed, dropped or joined."""
        if type_ is not None and self.stem:
            type_ = self.stemmed(type_)
        return None if type_ is None or self.drops(type_) else re.sub(r"\s+", self.spec.connector, type_)

    def final(self, word: str) -> str | None:
        """What becomes of a single word; None if it is dropped."""
        return self.finished(None if class_of(word) == NONE else self.type(word))

    def tokens(self, text: str) -> Iterator[tuple[int, int, str | None, str]]:
        """(start, end, type, class) of every word; the type is None for white space and dropped words."""
        words = list(scan(text))
        types = [None if k == NONE else self.type(text[a:b]) for a, b, k in words]
        at = 0
        while at < len(words):
            start, end, kind = words[at]
            type_, used = types[at], 1
            if type_ is not None and type_ in self.trie and (found := self._combined(words, types, at)):
                type_, used = found
                end = words[at + used - 1][1]
            yield start, end, self.finished(type_), kind
            at += used


@lru_cache(8)
def filter_of(spec: TokenSpec) -> Filter:
    return Filter(spec)
