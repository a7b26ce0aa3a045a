"""Text to rows: sentences and tokens as DataFrame operators.

The kernels are Arrow functions marked non-deterministic, so that Catalyst plans one call each
even where a generator or filter would otherwise repeat it. Offsets are in characters of the
decoded text. NULL text gives a NULL array, hence no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batch import Words, slices
from ..functions.sentences import KINDS, Suppressor, sentences as _sentences
from ..functions.tokens import TokenSpec, filter_of
from ..functions.width import width
from ..functions.words import PROPERTIES
from ..resources import suppressions, word_break
from ..sources.jsontype import unescape


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its source has fewer splits than that (a small or unsplittable file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def types_of(text: Column, spec: TokenSpec = TokenSpec()) -> Column:
    """ARRAY<STRING> of the types that the filter keeps: the narrow form, for counting."""

    @F.arrow_udf("array<string>")
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = filter_of(spec)
        for batch in batches:
            for texts in slices(batch):
                w = Words(texts, f)
                yield lists(pa.array(w.types, pa.string()).take(pa.array(w.which)), w.ends, texts)

    return kernel.asNondeterministic()(text)


def lists(rows: pa.Array, ends: np.ndarray, texts: list[str | None]) -> pa.Array:
    """A list array of the rows up to each text's end; missing texts are NULL."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, rows, mask=pa.array([t is None for t in texts], pa.bool_()))


_FIELDS = {"start": "int", "size": "int", "token": "string", "type": "string", "kind": "string"}


def tokens_of(text: Column, spec: TokenSpec = TokenSpec(), keep_dropped: bool = False, fields: tuple[str, ...] = tuple(_FIELDS)) -> Column:
    """ARRAY<STRUCT<start, size, token, type, kind>>, or of the named ``fields``; dropped words only with ``keep_dropped`` (their type is NULL)."""

    @F.arrow_udf(f"array<struct<{','.join(f'{c}:{_FIELDS[c]}' for c in fields)}>>")
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = filter_of(spec)
        for batch in batches:
            for texts in slices(batch):
                if keep_dropped:  # white space too
                    flat, ends = [[] for _ in _FIELDS], []
                    for t in texts:
                        for a, b, x, k in f.tokens(t) if t else ():
                            for column, v in zip(flat, (a, b - a, t[a:b], x, k)):
                                column.append(v)
                        ends.append(len(flat[0]))
                    columns = {c: pa.array(v, pa.int32() if _FIELDS[c] == "int" else pa.string()) for c, v in zip(_FIELDS, flat)}
                else:
                    w = Words(texts, f)
                    ends, which = np.array(w.ends), pa.array(w.which)
                    columns = {c: pa.array((w.start if c == "start" else w.size).astype(np.int32)) if _FIELDS[c] == "int" else pa.array(getattr(w, f"{c}s"), pa.string()).take(which) for c in fields}
                yield lists(pa.StructArray.from_arrays([columns[c] for c in fields], list(fields)), np.array(ends), texts)

    return kernel.asNondeterministic()(text)


def tokens(df: DataFrame, text: str = "text", spec: TokenSpec = TokenSpec(), keep_dropped: bool = False, fields: tuple[str, ...] = tuple(_FIELDS)) -> DataFrame:
    """The other columns of ``df`` with pos (from 0), start, size, token, type, kind (or the named ``fields`` of these): a row per token."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(tokens_of(F.col(text), spec, keep_dropped, fields)).alias("pos", "t")).select(*others, "pos", "t.*")


def counted_runs(df: DataFrame, n: int, text: str = "text", spec: TokenSpec = TokenSpec()) -> DataFrame:
    """(run, length, n): runs of 1 to ``n`` types within a text, joined by line feeds (which no type holds), counted by parts of a partition: a run comes more than once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = filter_of(spec)
        for batch in batches:
            for texts in slices(batch.column(0)):
                for length, (runs, counts) in enumerate(Words(texts, f).runs(n), 1):
                    yield pa.RecordBatch.from_arrays([runs.cast(pa.string()), pa.array(np.full(len(runs), length, np.int32)), pa.array(counts.astype(np.int64))], ["run", "length", "n"])

    return df.select(F.col(text)).mapInArrow(kernel, "run string, length int, n long")


def first_places(df: DataFrame, key: str, text: str = "text", spec: TokenSpec = TokenSpec()) -> DataFrame:
    """(type, key, pos): the first place of each type by key (nulls first) and position, by parts of a partition: a type comes more than once."""
    kind = df.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = filter_of(spec)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                keys = batch.column(0).slice(at, len(texts))
                at += len(texts)
                w = Words(texts, f)
                if not len(w.which):
                    continue
                coded = pa.array(w.types, pa.string()).take(pa.array(w.which)).dictionary_encode()
                rank = np.empty(len(texts), np.int64)
                rank[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(texts))
                pos = np.arange(len(w.which)) - np.concatenate([[0], w.ends])[w.text]
                order = np.lexsort((pos, rank[w.text]))
                _, first = np.unique(coded.indices.to_numpy()[order], return_index=True)
                first = order[first]
                yield pa.RecordBatch.from_arrays([coded.take(pa.array(first)).dictionary_decode(), keys.take(pa.array(w.text[first])), pa.array(pos[first].astype(np.int32))], ["type", key, "pos"])

    return df.select(key, F.col(text).alias("_text")).mapInArrow(kernel, f"type string, `{key}` {kind}, pos int")


_SENTENCE = {"start": "int", "size": "int", "kind": "string", "sentence": "string"}


def sentences_of(text: Column, crlf_as_space: bool = True, suppress: str | tuple[str, ...] | None = None, fields: tuple[str, ...] = tuple(_SENTENCE)) -> Column:
    """ARRAY<STRUCT<start, size, kind, sentence>>, or of the named ``fields``; ``suppress`` is a language or a tuple of abbreviations."""
    words = tuple(suppressions(suppress)) if isinstance(suppress, str) else suppress

    @F.arrow_udf(f"array<struct<{','.join(f'{c}:{_SENTENCE[c]}' for c in fields)}>>")
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        glue = Suppressor(words) if words else None
        for batch in batches:
            for texts in slices(batch):
                rows, ends, cut = [], [], []
                for t in texts:
                    for a, b, k in _sentences(t, crlf_as_space, glue) if t is not None else ():
                        rows.append((a, b - a, KINDS[k]))
                        if "sentence" in fields:
                            cut.append(t[a:b])
                    ends.append(len(rows))
                columns = dict(zip(_SENTENCE, (*zip(*rows), cut))) if rows else {}
                rows = pa.StructArray.from_arrays([pa.array(columns.get(c, ()), pa.int32() if _SENTENCE[c] == "int" else pa.string()) for c in fields], list(fields))
                yield lists(rows, np.array(ends), texts)

    return kernel.asNondeterministic()(text)


def sentences(df: DataFrame, text: str = "text", crlf_as_space: bool = True, suppress: str | tuple[str, ...] | None = None, fields: tuple[str, ...] = tuple(_SENTENCE)) -> DataFrame:
    """The other columns of ``df`` with pos, start, size, kind, sentence (or the named ``fields`` of these): a row per sentence."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(sentences_of(F.col(text), crlf_as_space, suppress, fields)).alias("pos", "s")).select(*others, "pos", "s.*")


_ESCAPE = re.compile(r"\\u[dD][89abAB]..\\u....|\\u....|\\.|.", re.DOTALL)


def source_sentences(raw: Column, crlf_as_space: bool = True) -> Column:
    """JSON line of the sentences of a JSON string given by its source: its escapes stay as they are written; ``null`` for NULL."""

    @F.arrow_udf("string")
    def kernel(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append("null")
                continue
            if "\\" not in t:
                cuts = [t[a:b] for a, b, _ in _sentences(t, crlf_as_space)]
            else:  # one piece of source per character
                pieces = _ESCAPE.findall(t)
                cuts = ["".join(pieces[a:b]) for a, b, _ in _sentences("".join(map(unescape, pieces)), crlf_as_space)]
            out.append("[" + ", ".join(f'"{x}"' for x in cuts) + "]")
        return pa.array(out, pa.string())

    return kernel.asNondeterministic()(raw)


def break_classes_of(text: Column) -> Column:
    """ARRAY<STRUCT<property, n>>: how many characters of a text have each word-break property."""
    item = pa.struct([("property", pa.string()), ("n", pa.int64())])

    @F.arrow_udf("array<struct<property:string,n:long>>")
    def kernel(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            counts: Counter = Counter()
            for char, n in Counter(t or "").items():
                counts[PROPERTIES[word_break(char)]] += n
            out.append(None if t is None else [{"property": k, "n": n} for k, n in sorted(counts.items())])
        return pa.array(out, pa.list_(item))

    return kernel.asNondeterministic()(text)


def width_of(text: Column) -> Column:
    """Display width of a text in cells; NULL for NULL."""

    @F.arrow_udf("long")
    def kernel(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else width(t) for t in texts.to_pylist()], pa.int64())

    return kernel(text)
