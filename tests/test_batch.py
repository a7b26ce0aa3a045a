"""Words of whole batches against the scanner, the bounds of batches, and counts by parts."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from lexmill.functions import batch as B
from lexmill.functions.sentences import ATERM, CR, EXTEND, FORMAT, LF, SEP, STERM, _classes, _Cursor
from lexmill.functions.tokens import MEMO, Filter, TokenSpec
from lexmill.operators import counts as C
from lexmill.operators.text import counted_runs, first_places, types_of
from lexmill.resources import stopwords

CHARS = list("aabbZÉéßöñ0129__..,;:'’·\"#@-!?$ \n\t\r$½Ⓐ") + ["\x01", "\x85", "\xa0", " ", " ", "​", "﻿", "­", "é", "́", "‍", "\U0001f600", "\U0001f1e9\U0001f1ea", "☝🏽", "漢", "カ", "א", "ไ", "http://a.b/c, ", "#a.b ", "͸", "ª", "²", "‿", "ﬁ", "ſ", "İ"]
SPECS = [
    TokenSpec(), TokenSpec(drop_classes=("punct", "symbol", "number")), TokenSpec(drop_classes=("punct", "symbol"), stem="english").without(stopwords("english")),
    TokenSpec(combine=("a b", "b'a", "é .", "a b a"), connector="+"), TokenSpec(case=False, compat=False, quote=False, ignorable=False, drop=("a", "the"), drop_except=(".",)),
]


def odd_texts(n=3000, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(CHARS[:26] if r.random() < 0.6 else CHARS) for _ in range(r.choice([0, 1, 2, 5, 30]))) for _ in range(n)]


@pytest.mark.parametrize("spec", SPECS)
def test_words_of_a_batch(spec):
    f, g, texts = Filter(spec), Filter(spec), [None, *odd_texts(), None]
    at = 0
    w = B.Words(texts, f)
    for t, end in zip(texts, w.ends):
        got = [(w.start[k], w.size[k], w.tokens[w.which[k]], w.types[w.which[k]], w.kinds[w.which[k]]) for k in range(at, end)]
        assert got == [(a, b - a, t[a:b], x, k) for a, b, x, k in g.tokens(t or "") if x is not None], t
        at = end


def test_batches_are_bounded():
    texts = ["x" * 400_000, None, "y"] * 40
    parts = list(B.slices(pa.array(texts)))
    assert [t for p in parts for t in p] == texts
    assert len(parts) > 5 and all(sum(len(t or "") for t in p) <= B.SLICE for p in parts)
    assert [r for p in B.slices(pa.array([["a"] * 200_000, None] * 9)) for r in p] == [["a"] * 200_000, None] * 9
    f = Filter(TokenSpec())
    f.types(" ".join(map(str, range(MEMO + 10))))
    assert len(f.memo) <= MEMO


def test_counts_by_parts(spark):
    texts = ["The cat. The cat", None, "", "cat the", "THE cat sat"] + odd_texts(60, 7)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    rows = df.select("id", types_of("text").alias("types"))
    for n in (1, 2, 3):
        want = {(*r.ngram,): r.weight for r in C.ngrams(rows, n).collect()}
        assert {(*r.ngram,): r.weight for r in C.text_ngrams(df, n).collect()} == want
    f, first = Filter(TokenSpec()), {}
    for i, t in enumerate(texts):
        for pos, x in enumerate(f.types(t or "")):
            first.setdefault(x, (i, pos))
    got = {}
    for r in first_places(df, "id").collect():
        got[r.type] = min(got.get(r.type, (99999, 0)), (r.id, r.pos))
    assert got == first
    repeated = spark.createDataFrame([("a b " * 500,)], "text string")
    assert {r.run: r.n for r in counted_runs(repeated, 2).collect()} == {"a": 500, "b": 500, "a\nb": 500, "b\na": 499}


def test_sentence_scan_leaps():
    """What lies between two characters that may end a sentence isn't walked through."""
    c = _Cursor("a" * 5000 + "́. B", True)
    c.skip()
    assert c.at == 4999 and set(_classes("\r\n.! ")) == {CR, LF, ATERM, STERM, SEP}
    assert Counter(_classes("́­")) == {EXTEND: 1, FORMAT: 1}
