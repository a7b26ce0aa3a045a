"""Newline-delimited JSON: lines, type scan, field projection, text selection."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batch import slices
from . import jsontype as J


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row per line, split at LF only; the last line may lack it."""
    return spark.read.option("lineSep", "\n").text(path)


_FIELD = "array<struct<name:string,value:string>>"
_ARROW = {"string": pa.string(), "array<string>": pa.list_(pa.string()), _FIELD: pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))}


def _kernel(f, schema: str, mode: str):
    def one(line):
        try:
            return None if line is None else f(line)
        except (ValueError, RecursionError) as e:  # types nested too deeply to be merged count as invalid
            if mode == "FAILFAST":
                raise ValueError(str(e)) from None
            return None

    @F.arrow_udf(schema)
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lines in slices(batch):
                yield pa.array(map(one, lines), _ARROW[schema])

    return kernel.asNondeterministic()  # else Catalyst may call it more than once per row


def type_of(line: Column, mode: str = "FAILFAST") -> Column:
    """Rendered type of a JSON line; blank lines are ``null``. PERMISSIVE gives SQL NULL for invalid lines."""
    return _kernel(lambda s: J.scan(s)[0].render(), "string", mode)(line)


def scan_types(df: DataFrame, line: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """(type, n): distinct line types with their counts."""
    return df.select(type_of(F.col(line), mode).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def scan_schema(df: DataFrame, line: str = "value", mode: str = "FAILFAST") -> tuple[J.JsonType, int]:
    """(union of all line types, rows). Types are folded in each task first, so only a few reach the driver."""
    types = scan_types(df, line, mode)

    def fold(batches):
        t, n = J.NULL, 0
        for b in batches:
            t, n = J.union([t, *(J.parse(x) for x in b["type"] if x is not None)]), n + int(b["n"].sum())
        yield pd.DataFrame({"type": [t.render()], "n": [n]})

    rows = types.mapInPandas(fold, "type string, n long").collect()
    return J.union(J.parse(r.type) for r in rows), sum(r.n for r in rows)


def get_field(line: Column, field: str, mode: str = "FAILFAST") -> Column:
    """The field's raw JSON exactly as it stands in the line, NULL if absent."""

    def cut(s):
        t, spans = J.scan(s)
        span = spans.get(field) if t.kind == "record" else None
        return s[span[0] : span[1]] if span else None

    return _kernel(cut, "string", mode)(line)


def text_of(line: Column, field: str = "text", mode: str = "FAILFAST") -> Column:
    """Decoded text of the field, or of a bare JSON string; NULL otherwise."""

    def pick(s):
        t, spans = J.scan(s)
        if t == J.TEXT:
            return J.decode_text(s)
        if t.kind == "record" and field in spans:
            raw = s[slice(*spans[field])]
            return J.decode_text(raw) if raw.startswith('"') else None
        return None

    return _kernel(pick, "string", mode)(line)


def fields_of(line: Column, mode: str = "FAILFAST") -> Column:
    """ARRAY<STRUCT<name, value>> of a record in source order (raw values); NULL for other types."""

    def walk(s):
        t, spans = J.scan(s)
        return [{"name": k, "value": s[a:b]} for k, (a, b) in spans.items()] if t.kind == "record" else None

    return _kernel(walk, _FIELD, mode)(line)


def n_fields(line: Column, mode: str = "FAILFAST") -> Column:
    return F.size(fields_of(line, mode))


def items_of(line: Column, mode: str = "FAILFAST") -> Column:
    """ARRAY<STRING> of the raw items of a JSON array in order; NULL for other types."""

    def walk(s):
        t, spans = J.scan(s)
        return [s[a:b] for a, b in spans.values()] if t.kind == "array" else None

    return _kernel(walk, "array<string>", mode)(line)


def n_items(line: Column, mode: str = "FAILFAST") -> Column:
    """Length of a JSON array; NULL for other types."""
    items = items_of(line, mode)
    return F.when(items.isNotNull(), F.size(items))


def as_bool(raw: Column) -> Column:
    """true and false; NULL for all else."""
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return F.when(bare == "true", True).when(bare == "false", False)


def as_text(raw: Column, mode: str = "FAILFAST") -> Column:
    """Decoded text of a JSON string; NULL for other types."""
    return _kernel(J.decode_text, "string", mode)(raw)


def as_double(raw: Column) -> Column:
    return raw.try_cast("double")


def as_int(raw: Column) -> Column:
    """Integer clipped to 32 bits."""
    d = raw.try_cast("double")
    return F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.greatest(F.least(d, F.lit(J.INT_MAX)), F.lit(J.INT_MIN)).cast("int"))


def text_array(items: Column, raw: bool = False) -> Column:
    """JSON line of an array of texts, ``null`` for NULL, with a space after each comma.

    Control and non-ASCII characters are escaped. With ``raw`` the texts are pieces of a JSON
    string's source, whose escapes pass through untouched.
    """

    one = (lambda t: f'"{t}"') if raw else json.dumps

    @F.arrow_udf("string")
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for rows in slices(batch):
                yield pa.array(["null" if r is None else "[" + ", ".join(map(one, r)) + "]" for r in rows], pa.string())

    return kernel(items)


def raw_text(line: Column, field: str = "text", mode: str = "FAILFAST") -> Column:
    """Source of the text that ``text_of`` decodes, without its quotes."""

    def pick(s):
        t, spans = J.scan(s)
        raw = s.strip() if t == J.TEXT else s[slice(*spans[field])] if t.kind == "record" and field in spans else ""
        return raw[1:-1] if raw.startswith('"') else None

    return _kernel(pick, "string", mode)(line)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON value per line of a single string column; NULL as ``null``."""
    c = df.columns[0]
    df.select(F.coalesce(F.col(c), F.lit("null")).alias("value")).write.option("lineSep", "\n").text(path)
