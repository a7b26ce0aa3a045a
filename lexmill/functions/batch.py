"""The words of many texts at once, by arrays of characters instead of a match per word.

Texts of plain characters (letters, digits, joiners, combining marks, signs and white space; no
emoji, ideographs, web addresses, hashtags or mentions) are parted by their word-break classes;
the others by ``words.scan``. Both give the same words. What becomes of a word is
worked out once per distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..resources import word_break_runs
from .tokens import Filter
from .words import NONE, PROPERTIES, scan

#: Bytes of text that are worked on at a time; bounds the memory of a batch of any number of rows.
SLICE = 1 << 21
_LETTER, _DIGIT, _JOIN, _IN_LETTERS, _IN_DIGITS, _BLANK, _TAG, _TAGGED, _MARK, _RARE = (1 << k for k in range(10))
_ROLES = {"aletter": _LETTER | _TAGGED, "numeric": _DIGIT | _TAGGED, "extendnumlet": _JOIN | _TAGGED, "number": _TAGGED, "midletter": _IN_LETTERS, "midnum": _IN_DIGITS, "midnumlet": _IN_LETTERS | _IN_DIGITS, "single_quote": _IN_LETTERS | _IN_DIGITS, "extend": _MARK, "format": _MARK}
_ELSEWHERE = {"zwj", "e_base", "e_base_gaz", "e_modifier", "glue_after_zwj", "regional_indicator", "hebrew_letter", "katakana", "letter"}
_GAP, _GAP_ROLE = np.array([10], np.uint32), np.array([_BLANK], np.uint16)


@lru_cache(1)
def _roles() -> np.ndarray:
    """The roles of every code point."""
    starts, classes = word_break_runs()
    of = np.array([_RARE if p in _ELSEWHERE else _ROLES.get(p, 0) for p in PROPERTIES], np.uint16)
    out = np.repeat(of[classes], np.diff([*starts, 0x110000]))
    for c in [*range(0x20), *range(0x7F, 0xA0), *(c for c in range(0xA0, 0x3001) if chr(c).isspace())]:
        out[c] = _RARE if out[c] else _BLANK
    out[[0x200B, 0xFEFF]] = _RARE
    out[0x20] = _BLANK
    out[[ord("#"), ord("@")]] |= _TAG
    return out


def _plain(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Code points and roles of a text of plain characters; None for others."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    roles = _roles()[points]
    if (roles & _RARE).any() or "://" in text:
        return None
    if ("#" in text or "@" in text) and ((roles[:-1] & _TAG != 0) & (roles[1:] & _TAGGED != 0)).any():
        return None
    return points, roles


def _edges(roles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words that aren't white space, and which characters are theirs."""
    body = roles & (_LETTER | _DIGIT | _JOIN) != 0
    joins = np.flatnonzero(roles[1:-1] & (_IN_LETTERS | _IN_DIGITS)) + 1
    before, at, after = roles[joins - 1], roles[joins], roles[joins + 1]
    body[joins[((before & after & _LETTER != 0) & (at & _IN_LETTERS != 0)) | ((before & after & _DIGIT != 0) & (at & _IN_DIGITS != 0))]] = True
    theirs = body | (roles & _BLANK == 0)
    alone = theirs & ~body
    first, last = body | alone, body | alone
    first[1:] &= alone[1:] | ~body[:-1]
    last[:-1] &= alone[:-1] | ~body[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1, theirs


def _strings(kept: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of these sizes that stand one after another."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    data = kept.tobytes().decode("utf-32-le").encode()
    if len(data) > len(kept):
        width = np.zeros(len(kept) + 1, np.int64)
        np.cumsum((kept >= 0x80).astype(np.int8) + (kept >= 0x800) + (kept >= 0x10000) + 1, out=width[1:])
        offsets = width[offsets]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


class Words:
    """Words of consecutive texts: ``ends`` (by text), ``text``, ``start``, ``size``, ``which`` (by word) and, by distinct word, ``tokens``, ``types`` (None: dropped) and ``kinds``.

    White space is left out; with ``dropped`` unset so are the words without a type.
    """

    def __init__(self, texts: list[str], f: Filter, dropped: bool = False):
        plain, points, roles, odd = [], [], [], []
        for i, t in enumerate(texts):
            if t and (found := _plain(t)):
                plain.append(i)
                points += (found[0], _GAP)
                roles += (found[1], _GAP_ROLE)
            elif t:
                odd.append(i)
        words, known, where, start, size, which = [], {}, [], [], [], []
        kinds: list[str | None] = []
        if plain:
            points, roles = np.concatenate(points), np.concatenate(roles)
            at = marked = np.flatnonzero(roles & _MARK)
            if len(marked):  # a mark belongs to what it follows, but to no white space
                base = np.ones(len(roles), bool)
                base[marked] = (marked == 0) | (roles[marked - 1] & _BLANK != 0)
                at = np.append(np.flatnonzero(base), len(roles))
                a, b, theirs = _edges(roles[at[:-1]])
                a, b, theirs = at[a], at[b], np.repeat(theirs, np.diff(at))
            else:
                a, b, theirs = _edges(roles)
            firsts = np.cumsum([0, *(len(texts[i]) + 1 for i in plain)])
            text = np.repeat(np.arange(len(plain)), np.diff(np.searchsorted(a, firsts)))
            coded = _strings(points[theirs], b - a).dictionary_encode()
            words = coded.dictionary.to_pylist()
            kinds = [None] * len(words)
            where, start, size, which = [np.array(plain)[text]], [a - firsts[text]], [b - a], [coded.indices.to_numpy().astype(np.int64)]
        for i in odd:
            t, at, rows = texts[i], [], []
            for a, b, k in scan(t):
                if k != NONE:
                    key = t[a:b], k
                    if key not in known:
                        known[key] = len(words)
                        words.append(key[0])
                        kinds.append(k)
                    rows.append((a, b - a, known[key]))
            if rows:
                at = np.array(rows, np.int64)
                where.append(np.full(len(at), i))
                start.append(at[:, 0])
                size.append(at[:, 1])
                which.append(at[:, 2])
        none = [np.zeros(0, np.int64)]
        where, start, size, which = (np.concatenate(x or none) for x in (where, start, size, which))
        if odd and plain:
            order = np.argsort(where, kind="stable")
            where, start, size, which = where[order], start[order], size[order], which[order]
        self.tokens: list[str] = words
        mapped, self.types, self.kinds = f.mapped(words, kinds)
        real = np.array([k != NONE for k in self.kinds], bool)
        if not real.all():
            where, start, size, which = (x[real[which]] for x in (where, start, size, which))
        if f.trie:
            where, start, size, which = self._combine(texts, f, mapped, where, start, size, which)
        if not dropped:
            kept = np.array([x is not None for x in self.types], bool)
            if not kept.all():
                where, start, size, which = (x[kept[which]] for x in (where, start, size, which))
        self.ends = np.searchsorted(where, np.arange(len(texts)), "right")
        self.text, self.start, self.size, self.which = where, start, size, which

    def runs(self, n: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """For each length up to ``n``, the distinct runs of types within a text (joined by line feeds, which no type holds) and their counts."""
        if not len(self.which):
            return
        coded = pa.array(self.types, pa.string()).take(pa.array(self.which)).dictionary_encode()
        one, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        yield one, np.bincount(ids, minlength=len(one))
        run, runs = ids, one
        for k in range(2, n + 1):
            run = run[:-1] * len(one) + ids[k - 1 :]
            distinct, inverse, counts = np.unique(run, return_inverse=True, return_counts=True)
            within = np.zeros(len(distinct), np.int64)
            np.add.at(within, inverse, self.text[: len(run)] == self.text[k - 1 :])
            runs = pc.binary_join_element_wise(runs.take(pa.array(distinct // len(one))), one.take(pa.array(distinct % len(one))), "\n")
            run, some = inverse, within > 0
            yield runs.filter(pa.array(some)), within[some]
            if not len(run):
                return

    def _combine(self, texts, f, mapped, where, start, size, which):
        """Rows of words that a rule combines become one row of a distinct word of their own."""
        begins = np.array([x in f.trie for x in mapped], bool)
        gone, made, until = np.zeros(len(which), bool), {}, 0
        w, doc, a, b = which.tolist(), where.tolist(), start.tolist(), (start + size).tolist()
        which, size = which.copy(), size.copy()
        for at in np.flatnonzero(begins[which]).tolist():
            if at < until:
                continue
            node, k, best = f.trie.get(mapped[w[at]]), at + 1, None
            while node is not None:
                if None in node:
                    best = node[None], k
                if k == len(w) or doc[k] != doc[at]:
                    break
                if a[k] > b[k - 1]:
                    node = node.get(" ")
                node, k = node and node.get(mapped[w[k]]), k + 1
            if best:
                type_, until = best
                token, kind = texts[doc[at]][a[at] : b[until - 1]], self.kinds[w[at]]
                if (token, type_, kind) not in made:
                    made[token, type_, kind] = len(self.tokens)
                    self.tokens.append(token)
                    self.types.append(f.finished(type_))
                    self.kinds.append(kind)
                which[at], size[at] = made[token, type_, kind], b[until - 1] - a[at]
                gone[at + 1 : until] = True
        return where[~gone], start[~gone], size[~gone], which[~gone]



def slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts (or lists of texts) of a batch, ``SLICE`` bytes (or an eighth as many items) at a time; one of more than that alone."""
    sizes = pc.list_value_length(texts) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    sizes = pc.fill_null(sizes, 0).cast(pa.int64())
    ends = pc.cumulative_sum(pc.multiply(sizes, 8) if pa.types.is_list(texts.type) else sizes).to_numpy()
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield texts.slice(at, to - at).to_pylist()
        at = to
