"""The published English (Porter 2) algorithm in SQL, step by step, for words without apostrophes."""

from __future__ import annotations

_V = "[aeiouy]"
_C = "[^aeiouy]"
_SHORT = f"(regexp_matches(w, '{_C}{_V}[^aeiouywxY]$') OR regexp_full_match(w, '{_V}{_C}'))"
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {x: x for x in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_STOP = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_TWO = "ization:ize ational:ate fulness:ful ousness:ous iveness:ive tional:tion biliti:ble lessli:less entli:ent ation:ate alism:al aliti:al ousli:ous iviti:ive fulli:ful enci:ence anci:ance abli:able izer:ize ator:ate alli:al bli:ble"
_THREE = "ational:ate tional:tion alize:al icate:ic iciti:ic ical:ic ful: ness:"
_FOUR = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic"


def _suffixes(pairs: str, region: str, rest: str) -> str:
    """The longest suffix decides; it is replaced in its region only."""
    cases = []
    for pair in sorted(pairs.split(), key=lambda p: -len(p.partition(":")[0])):
        suffix, _, to = pair.partition(":")
        cases.append(f"WHEN suffix(w, '{suffix}') THEN CASE WHEN length(w) - {len(suffix)} >= {region} THEN left(w, -{len(suffix)}) || '{to}' ELSE w END")
    return f"CASE {' '.join(cases)} {rest} ELSE w END"


def english(table: str) -> str:
    """CTEs ending in ``stemmed(word, stem)`` of the words in ``table(word)``."""
    quoted = lambda words: ", ".join(f"'{x}'" for x in words)
    area = f"regexp_extract({{}}, '^(?s:.*?){_V}{_C}')"
    steps = [
        f"CASE WHEN suffix(w, 'sses') THEN left(w, -2) WHEN suffix(w, 'ied') OR suffix(w, 'ies') THEN left(w, CASE WHEN length(w) > 4 THEN -2 ELSE -1 END) WHEN suffix(w, 's') AND NOT (suffix(w, 'us') OR suffix(w, 'ss')) AND regexp_matches(left(w, -1), '{_V}.') THEN left(w, -1) ELSE w END",
        f"CASE WHEN w IN ({quoted(_STOP)}) THEN w WHEN regexp_matches(w, 'eed(ly)?$') THEN CASE WHEN length(regexp_extract(w, '^(.*)eed(?:ly)?$', 1)) >= r1 THEN regexp_extract(w, '^(.*ee)d(?:ly)?$', 1) ELSE w END WHEN regexp_matches(w, '{_V}.*(ed|edly|ing|ingly)$') THEN regexp_replace(w, '(edly|ed|ingly|ing)$', '!') ELSE w END",
        f"CASE WHEN NOT suffix(w, '!') THEN w WHEN regexp_matches(w, '(at|bl|iz)!$') THEN left(w, -1) || 'e' WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)!$') THEN left(w, -2) WHEN r1 >= length(w) - 1 AND {_SHORT.replace('(w,', '(left(w, -1),')} THEN left(w, -1) || 'e' ELSE left(w, -1) END",
        f"CASE WHEN w IN ({quoted(_STOP)}) THEN w WHEN regexp_matches(w, '.{_C}[yY]$') THEN left(w, -1) || 'i' ELSE w END",
        f"CASE WHEN w IN ({quoted(_STOP)}) THEN w ELSE {_suffixes(_TWO, 'r1', '''WHEN suffix(w, 'ogi') THEN CASE WHEN length(w) - 3 >= r1 AND suffix(w, 'logi') THEN left(w, -1) ELSE w END WHEN regexp_matches(w, '[cdeghkmnrt]li$') AND length(w) - 2 >= r1 THEN left(w, -2)''')} END",
        f"CASE WHEN w IN ({quoted(_STOP)}) THEN w ELSE {_suffixes(_THREE, 'r1', '''WHEN suffix(w, 'ative') AND length(w) - 5 >= r2 THEN left(w, -5)''')} END",
        f"CASE WHEN w IN ({quoted(_STOP)}) THEN w ELSE {_suffixes(_FOUR, 'r2', '''WHEN regexp_matches(w, '[st]ion$') AND length(w) - 3 >= r2 THEN left(w, -3)''')} END",
        f"CASE WHEN w IN ({quoted(_STOP)}) THEN w WHEN suffix(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {_SHORT.replace('(w,', '(left(w, -1),')} THEN left(w, -1) ELSE w END WHEN suffix(w, 'll') AND length(w) - 1 >= r2 THEN left(w, -1) ELSE w END",
    ]
    whole = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _WHOLE.items())
    out = f"""st0 AS (SELECT DISTINCT word, array_to_string(list_transform(string_split(word, ''), lambda c, i: CASE WHEN c = 'y' AND (i = 1 OR regexp_matches(word[i - 1], '{_V}')) THEN 'Y' ELSE c END), '') AS w FROM {table}),
st_r AS (SELECT word, w, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) WHEN {area.format('w')} <> '' THEN length({area.format('w')}) ELSE length(w) END AS r1 FROM st0),
st1 AS (SELECT word, w, r1, CASE WHEN {area.format('substr(w, r1 + 1)')} <> '' THEN r1 + length({area.format('substr(w, r1 + 1)')}) ELSE length(w) END AS r2 FROM st_r)"""
    for k, step in enumerate(steps, 1):
        out += f",\nst{k + 1} AS (SELECT word, r1, r2, {step} AS w FROM st{k})"
    return out + f",\nstemmed AS (SELECT word, CASE word {whole} ELSE CASE WHEN length(word) <= 2 THEN word ELSE lower(w) END END AS stem FROM st{len(steps) + 1})"
