"""A lattice of JSON types: null below all, any above all; strict scanner, union, rendering."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import types as T


@dataclass(frozen=True)
class JsonType:
    kind: str  # null boolean integer real text array record any
    item: JsonType | None = None
    length: int = -1
    fields: tuple[tuple[str, JsonType], ...] = ()

    def __or__(self, other: JsonType) -> JsonType:
        """Least upper bound."""
        a, b = self, other
        if a == b or b.kind == "null" or a.kind == "any":
            return a
        if a.kind == "null" or b.kind == "any":
            return b
        if {a.kind, b.kind} == {"integer", "real"}:
            return REAL
        if a.kind == b.kind == "array":
            return JsonType("array", a.item | b.item, a.length if a.length == b.length else -1)
        if a.kind == b.kind == "record":
            x, y = dict(a.fields), dict(b.fields)
            return record({k: x.get(k, NULL) | y.get(k, NULL) for k in {**x, **y}})
        return ANY

    def render(self) -> str:
        if self.kind == "array":
            return f"[{self.item.render()}; {self.length}]" if self.length >= 0 else f"[{self.item.render()}]"
        if self.kind == "record":
            return "{ " + ", ".join(f'"{k}": {t.render()}' for k, t in self.fields) + " }" if self.fields else "{}"
        return self.kind

    def to_spark(self) -> T.DataType:
        simple = {"null": T.NullType(), "boolean": T.BooleanType(), "integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "any": T.VariantType()}
        if self.kind == "array":
            return T.ArrayType(self.item.to_spark())
        if self.kind == "record":
            return T.StructType([T.StructField(k, t.to_spark()) for k, t in self.fields])
        return simple[self.kind]


NULL, BOOLEAN, INTEGER, REAL, TEXT, ANY = map(JsonType, ("null", "boolean", "integer", "real", "text", "any"))


def array(item: JsonType, length: int = -1) -> JsonType:
    return JsonType("array", item, length)


def record(fields: dict[str, JsonType]) -> JsonType:
    """Fields are unordered: kept sorted by name, in NFC."""
    return JsonType("record", fields=tuple(sorted((unicodedata.normalize("NFC", k), t) for k, t in fields.items())))


def union(types) -> JsonType:
    return reduce(JsonType.__or__, types, NULL)


_BLANK = re.compile(r"[ \t\r\n\v\f]*")
_NUMBER = re.compile(r"[+-]?(?:(?P<real>Infinity|NaN|(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|\d+)(?![\w.+-])")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}))*)"')
_ESCAPE = re.compile(r"\\(?:u([dD][89abAB]..)\\u(....)|u(....)|(.))")
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def unescape(raw: str) -> str:
    def one(m):
        if m[1]:
            return chr(0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00)
        return chr(int(m[3], 16)) if m[3] else _PLAIN.get(m[4], m[4])

    return _ESCAPE.sub(one, raw) if "\\" in raw else raw


class _Open:
    """A record or array that isn't closed yet."""

    def __init__(self, named: bool):
        self.named, self.close = named, "}" if named else "]"
        self.fields: dict[str, JsonType] = {}
        self.item, self.n, self.name, self.start = NULL, 0, None, 0

    def add(self, t: JsonType) -> None:
        if self.named:
            self.fields[self.name] = t
        else:
            self.item = self.item | t
            self.n += 1


class _Scanner:
    def __init__(self, text: str):
        self.s, self.at = text, 0

    def blank(self):
        self.at = _BLANK.match(self.s, self.at).end()

    def fail(self):
        raise ValueError(f"invalid JSON at character {self.at}")

    def expect(self, c: str):
        self.blank()
        if not self.s.startswith(c, self.at):
            self.fail()
        self.at += len(c)

    def string(self) -> str:
        self.blank()
        m = _STRING.match(self.s, self.at)
        if not m:
            self.fail()
        self.at = m.end()
        return m[1]

    def scalar(self) -> JsonType:
        if self.s.startswith('"', self.at):
            self.string()
            return TEXT
        for word, t in (("null", NULL), ("true", BOOLEAN), ("false", BOOLEAN)):
            if self.s.startswith(word, self.at):
                self.at += len(word)
                return t if not re.match(r"\w", self.s[self.at : self.at + 1] or " ") else self.fail()
        m = _NUMBER.match(self.s, self.at)
        if not m:
            self.fail()
        self.at = m.end()
        return REAL if m["real"] else INTEGER

    def key(self, frame: _Open) -> None:
        """Read a field's name up to its value."""
        key = unicodedata.normalize("NFC", unescape(self.string()))
        if key in frame.fields:
            self.fail()
        self.expect(":")
        self.blank()
        frame.name, frame.start = key, self.at

    def value(self, spans: dict | None = None) -> JsonType:
        """Read a value with an explicit stack, so that depth is bounded by memory alone; ``spans`` takes those of its own items or fields."""
        stack: list[_Open] = []
        while True:
            self.blank()
            c = self.s[self.at : self.at + 1]
            if c in ("[", "{") and c:
                frame, self.at = _Open(c == "{"), self.at + 1
                self.blank()
                if not self.s.startswith(frame.close, self.at):
                    stack.append(frame)
                    if frame.named:
                        self.key(frame)
                    else:
                        frame.start = self.at
                    continue
                self.at += 1
                t = record({}) if frame.named else array(NULL, 0)
            else:
                t = self.scalar()
            while stack:  # the value ends here; close what ends with it
                frame = stack[-1]
                if spans is not None and len(stack) == 1:
                    spans[frame.name if frame.named else frame.n] = (frame.start, self.at)
                frame.add(t)
                self.blank()
                if not self.s.startswith(frame.close, self.at):
                    self.expect(",")
                    self.blank()
                    if frame.named:
                        self.key(frame)
                    else:
                        frame.start = self.at
                    break
                self.at += 1
                stack.pop()
                t = record(frame.fields) if frame.named else array(frame.item, frame.n)
            else:
                return t

    def end(self):
        self.blank()
        if self.at < len(self.s):
            self.fail()


def scan(line: str) -> tuple[JsonType, dict[str | int, tuple[int, int]]]:
    """Type of a whole line and the spans of its top-level fields (by name) or items (by number) in source order; ValueError if invalid."""
    s, spans = _Scanner(line), {}
    s.blank()
    t = NULL if s.at == len(line) else s.value(spans)
    s.end()
    return t, spans


def parse(rendered: str) -> JsonType:
    """The type that ``render`` shows as this string."""
    s = _Scanner(rendered)

    def one() -> JsonType:
        s.blank()
        if s.s.startswith("[", s.at):
            s.at += 1
            item, n = one(), -1
            s.blank()
            if m := re.compile(r";\s*(\d+)").match(s.s, s.at):
                s.at, n = m.end(), int(m[1])
            s.expect("]")
            return array(item, n)
        if s.s.startswith("{", s.at):
            s.at += 1
            fields = {}
            s.blank()
            while not s.s.startswith("}", s.at):
                key = s.string()
                s.expect(":")
                fields[key] = one()
                s.blank()
                if s.s.startswith(",", s.at):
                    s.at += 1
            s.at += 1
            return record(fields)
        m = re.compile("null|boolean|integer|real|text|any").match(s.s, s.at)
        if not m:
            s.fail()
        s.at = m.end()
        return JsonType(m[0])

    return one()


INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def decode_bool(line: str) -> bool | None:
    return {"true": True, "false": False}.get(line.strip())


def decode_int(line: str) -> int | None:
    """Integer clipped to 32 bits."""
    return max(INT_MIN, min(INT_MAX, int(line))) if scan(line)[0] == INTEGER else None


def decode_double(line: str) -> float | None:
    return float(line) if scan(line)[0] in (INTEGER, REAL) else None


def decode_text(line: str) -> str | None:
    return unescape(line.strip()[1:-1]) if scan(line)[0] == TEXT else None
