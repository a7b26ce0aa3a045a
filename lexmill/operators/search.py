"""Term search: every occurrence of every term over the kept tokens, overlaps included."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batch import Words, slices
from ..functions.tokens import TokenSpec, filter_of
from .text import lists, tokens_of

#: Terms are broadcast up to this many; a larger term table joins by shuffle.
BROADCAST_TERMS = 100_000


def terms_frame(spark, terms: list[str], spec: TokenSpec = TokenSpec()) -> DataFrame:
    """(term_id, term, types): terms passed through the same filter; equal types share the first id, empty ones are refused."""
    f, seen, rows = filter_of(spec), {}, []
    for term in terms:
        types = tuple(x for _, _, x, _ in f.tokens(term) if x is not None)
        if not types:
            raise ValueError(f"term {term!r} has no tokens")
        if types not in seen:
            seen[types] = len(seen)
            rows.append((seen[types], term, list(types)))
    return spark.createDataFrame(rows, "term_id int, term string, types array<string>")


def occurrences(items: Column, lengths: list[int]) -> Column:
    """Array of (types, first, last) of all runs of the given lengths of an array of tokens with field ``type``."""

    def runs(k: int) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(items) - (k - 1)), lambda i: F.struct(F.transform(F.slice(items, i, k), lambda s: s["type"]).alias("types"), F.element_at(items, i).alias("first"), F.element_at(items, i + (k - 1)).alias("last")))
        return F.when(F.size(items) >= k, run)

    return F.flatten(F.filter(F.array(*map(runs, lengths)), lambda x: x.isNotNull()))


_MATCH = "array<struct<term_id:int,start:int,size:int,end_pos:int,length:int>>"


def matches(text: Column, terms: list[tuple[int, list[str]]], spec: TokenSpec = TokenSpec()) -> Column:
    """Array of matches in order of their last token, longest first; a trie is followed from tokens that start a term only."""

    @F.arrow_udf(_MATCH)
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie: dict = {}
        for term, types in terms:
            node = trie
            for x in types:
                node = node.setdefault(x, {})
            node[None] = term
        f = filter_of(spec)
        for batch in batches:
            for texts in slices(batch):
                w = Words(texts, f)
                starting = np.flatnonzero(np.array([x in trie for x in w.types], bool)[w.which]) if len(w.which) else np.zeros(0, np.int64)
                doc = np.searchsorted(w.ends, starting, "right")
                types, start, size, ends, found = w.types, w.start, w.size, w.ends.tolist(), []
                for i, d in zip(starting.tolist(), doc.tolist()):
                    node, k = trie[types[w.which[i]]], i
                    while node is not None:
                        if None in node:
                            found.append((d, k, i - k - 1, node[None], i))
                        k += 1
                        node = node.get(types[w.which[k]]) if len(node) > (None in node) and k < ends[d] else None
                found.sort()
                d, k, n, term, i = np.array(found, np.int64).reshape(-1, 5).T
                end = start[k] + size[k]
                columns = [term, start[i], end - start[i], end, -n]
                rows = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], ["term_id", "start", "size", "end_pos", "length"])
                yield lists(rows, np.searchsorted(d, np.arange(len(texts)), "right"), texts)

    return kernel.asNondeterministic()(text)


def search(df: DataFrame, terms: DataFrame, text: str = "text", spec: TokenSpec = TokenSpec()) -> DataFrame:
    """The other columns of ``df`` with term_id, term, start, size, end_pos, length.

    A match spans from its first token to its last, with ignored text between; matches go by last
    token, longest first. Up to ``BROADCAST_TERMS`` terms are matched within the token kernel; more
    are joined to the runs of tokens of their lengths by one hash join.
    """
    others, known = [c for c in df.columns if c != text], terms.select("term_id", "term", "types")
    if terms.count() <= BROADCAST_TERMS:
        few = [(r.term_id, list(r.types)) for r in known.collect()]
        each = df.select(*others, F.inline(matches(F.col(text), few, spec)))
        return each.join(F.broadcast(known.select("term_id", "term")), "term_id").select(*others, "term_id", "term", "start", "size", "end_pos", "length")
    lengths = sorted(r[0] for r in terms.select(F.size("types")).distinct().collect())
    items = df.select(*others, tokens_of(F.col(text), spec).alias("_items"))
    found = items.select(*others, F.explode(occurrences(F.col("_items"), lengths)).alias("_o")).select(*others, "_o.*").join(known, "types")
    end = F.col("last.start") + F.col("last.size")
    return found.select(*others, "term_id", "term", F.col("first.start").alias("start"), (end - F.col("first.start")).alias("size"), end.alias("end_pos"), F.size("types").alias("length"))
