"""Sentence rules in SQL, for texts of Latin letters with line feeds as spaces.

A mark is put after each terminator with its closers and spaces, and taken away again where a rule
forbids the break: before a continuer or another terminator, between a full stop and a digit,
between letter, full stop and capital, and where a lower-case letter is the next letter to follow.
"""

from __future__ import annotations

import re

_M = r"\x01"
_CLOSE, _SPACE = r"[\"'()\[\]{}]*", r"[ \n]*"
_LETTER, _UPPER, _LOWER = "A-Za-zÀ-ÖØ-öø-ÿ", "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"


def _literal(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def sentences(table: str = "documents", key: str = "doc_id", abbreviations: list[str] | None = None) -> str:
    """CTEs ending in ``sentence(key, pos, start, size, kind, sentence)``."""
    steps = [
        (rf"([.!?]{_CLOSE}{_SPACE})", rf"'\1' || chr(1)"),
        (rf"{_M}([.!?,:-])", r"'\1'"),
        (rf"\.{_M}([0-9])", r"'.\1'"),
        *[(rf"([{_LETTER}]\.){_M}([{_UPPER}])", r"'\1\2'")] * 2,
        (rf"(\.{_CLOSE}{_SPACE}){_M}([^{_LETTER}.!?]*[{_LOWER}])", r"'\1\2'"),
    ]
    text = "text"
    for pattern, to in steps:
        text = f"regexp_replace({text}, {_literal(pattern)}, {to}, 'g')"
    ends = lambda marks: _literal(rf"{marks}{_CLOSE}{_SPACE}$")
    glued = "false"
    if abbreviations:
        known = "|".join(sorted((re.escape(a).replace("'", "''") for a in abbreviations if " " not in a), key=len, reverse=True))
        glued = rf"pos < n - 1 AND regexp_matches(piece, {ends(chr(92) + '.')}) AND regexp_matches(piece, '(?:^|[ \n.!?\"''()\[\]{{}}])(?:{known})[ \n]*$')"
    return rf"""cut AS (SELECT {key}, string_split(CASE WHEN text = '' THEN '' ELSE regexp_replace({text}, '{_M}$', '') END, chr(1)) AS ps FROM {table} WHERE text IS NOT NULL),
piece AS (SELECT {key}, i - 1 AS pos, len(ps) AS n, ps[i] AS piece FROM cut, unnest(range(1, len(ps) + 1)) AS r(i)),
mark AS (SELECT *, {glued} AS glued FROM piece),
part AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY pos) - CASE WHEN glued THEN 0 ELSE 1 END AS s FROM mark),
whole AS (SELECT {key}, s::BIGINT AS pos, string_agg(piece, '' ORDER BY pos) AS sentence FROM part GROUP BY ALL),
sentence AS (SELECT {key}, pos, coalesce(sum(length(sentence)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(sentence) AS size,
  CASE WHEN regexp_matches(sentence, {ends(chr(92) + ".")}) THEN 'aterm' WHEN regexp_matches(sentence, {ends("[!?]")}) THEN 'sterm' ELSE 'none' END AS kind, sentence FROM whole)"""
