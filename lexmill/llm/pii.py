"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Fixed patterns give e-mail addresses, IP addresses, card and phone numbers; these spans always
stay. The method's seed entities are those spans and secret-shaped runs (32 or more characters of
a key with digits and letters). Each seed induces the lexical patterns it stands in: the two
tokens before it, the one before if it is a label (it ends in a mark such as a colon), the tokens
on either side, a label glued to it; tokens are whole and parted by white space, digits masked,
and the text's ends count as tokens. Patterns with ``support`` or more distinct seeds are counted
in all texts; where seeds are at least the share ``promise`` of what stands in a pattern (so not for pairs of
common words), it is looked up, and every token that stands in it, of whatever shape, is an instance.
Spark scores this pattern-instance graph iteratively: a pattern is as reliable as the share of
its distinct instances that are personal data, smoothed; an instance that is no seed is as
reliable as its best pattern. What stands in a pattern of at least ``support`` distinct instances
and a reliability of ``reliable`` is a new span of kind ``context``, unless it meets a base span; a
secret-shaped run by itself is none.

Each regular expression runs in time linear in the text: a failed start can't be retried further
on in the same run. Defined cases: null text is empty; rows that repeat an id are searched each;
an empty table gives an empty result; other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import name
from .kernels import bounded, sliced
from .scratch import discard, scratch

KINDS = ("email", "ip", "card", "phone", "context")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0]) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


#: Stands for a token before the start or after the end of a text; real tokens hold no line end.
_EDGE = b"\n"
#: A-Z lower-cased and digits masked, byte for byte, so that offsets stay.
_MASK = bytes(48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WRAP = b"\"'`()[]{}<>,;.!?*"
_LABEL = tuple(b":=#>|(")
_KEY = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+")
_TOKEN = re.compile(rb"[^\x20\t\n\r\x0b\x0c]+")
_GLUED = re.compile(rb"(?<![^\x20\t\n\r\x0b\x0c])([^\x20\t\n\r\x0b\x0c]*[=:])([^\x20\t\n\r\x0b\x0c]*)")


def key_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of secret-shaped runs: 32 or more characters of keys, at least 8 digits and 8 letters."""
    out = []
    for m in _KEY.finditer(raw):
        digits = sum(48 <= c <= 57 for c in m[0])
        if digits >= 8 and sum(c > 64 and c != 95 for c in m[0]) >= 8:
            out.append(m.span())
    return out


def _whole(token: bytes) -> bytes:
    """A token of a pattern; a long one is stood for by its hash."""
    return token if len(token) <= 64 else b"\x01" + blake2b(token, digest_size=16).hexdigest().encode()


def _instance(raw: bytes) -> bytes:
    return blake2b(raw.lower(), digest_size=16).digest()


def _around(raw: bytes, start: int, end: int) -> tuple[bytes, bytes, bytes, bytes | None]:
    """Masked tokens two before, before and after a span, and what is glued to its front (None: nothing)."""
    at, found = start, []
    while len(found) < 3:
        while at and raw[at - 1] in b" \t\n\r\x0b\x0c":
            at -= 1
        stop = at
        while at and raw[at - 1] not in b" \t\n\r\x0b\x0c":
            at -= 1
        found.append((at, stop))
    glued = None
    if found[0][1] == start and found[0][0] < start:  # part of the span's own token
        (a, b), found = found[0], found[1:]
        glued = raw[a:b].translate(_MASK)
    m = _TOKEN.search(raw, end)
    if m and m.start() == end:  # the rest of the span's own token
        m = _TOKEN.search(raw, m.end())
    near = [_whole(raw[a:b].translate(_MASK)) if a < b else _EDGE for a, b in found[:2]]
    return near[1], near[0], _whole(m[0].translate(_MASK)) if m else _EDGE, glued


def patterns_of(raw: bytes, start: int, end: int) -> list[bytes]:
    """The lexical patterns a span stands in: two tokens before it; one, if it is a label; one on either side; a label glued to it."""
    two, one, after, glued = _around(raw, start, end)
    if glued is not None and (rest := glued.lstrip(_WRAP)) and rest.strip(_WRAP):
        return [b"p " + _whole(rest)] if rest[-1:] in (b"=", b":") else []
    out = [b"2 " + two + b" " + one, b"m " + one + b" " + after]
    return [*out, b"1 " + one] if one[-1] in _LABEL else out


class _Known:
    """Patterns by kind, for look-ups."""

    def __init__(self, patterns):
        self.two, self.mid, self.one, self.glued = set(), set(), set(), set()
        for p in patterns:
            kind, rest = p[:1], p[2:]
            if kind in b"2m":
                # the edge mark holds no space, so the first space parts the tokens
                {b"2": self.two, b"m": self.mid}[kind].add(tuple(rest.split(b" ", 1)))
            else:
                {b"1": self.one, b"p": self.glued}[kind].add(rest)
        self.hashed = any(b"\x01" in p for p in patterns)


def _hits(raw: bytes, known: _Known | None) -> list[tuple[bytes, int]]:
    """(pattern, token number) of every token that stands in a known pattern of the tokens around it (in any, without ``known``)."""
    tokens = raw.translate(_MASK).split()
    if known is None or known.hashed:
        tokens = list(map(_whole, tokens))
    t, n = [_EDGE, _EDGE, *tokens, _EDGE], len(tokens)
    if known is None:
        return [(b"2 " + t[i] + b" " + t[i + 1], i) for i in range(n)] + [(b"m " + t[i + 1] + b" " + t[i + 3], i) for i in range(n)] + [(b"1 " + t[i + 1], i) for i in range(n) if t[i + 1][-1] in _LABEL]
    two, mid, one = known.two, known.mid, known.one
    hits = [(b"2 %b %b" % p, i) for i, p in enumerate(zip(t, t[1:])) if p in two and i < n]
    hits += [(b"m %b %b" % p, i) for i, p in enumerate(zip(t[1:], t[3:])) if p in mid]
    return hits + [(b"1 " + x, i) for i, x in enumerate(t[1:]) if x in one and i < n] if one else hits


def _labelled(raw: bytes, known: _Known | None) -> list[tuple[bytes, int, int]]:
    """(pattern, start, end) of what is glued to a known label."""
    out = []
    if (known is None or known.glued) and (b"=" in raw or b":" in raw):
        for m in _GLUED.finditer(raw):
            label = m[1].translate(_MASK).lstrip(_WRAP)
            end = m.end(1) + len(m[2].rstrip(_WRAP))
            start = end - len(raw[m.end(1) : end].lstrip(_WRAP))
            if label.strip(_WRAP) and start < end and (known is None or _whole(label) in known.glued):
                out.append((b"p " + _whole(label), start, end))
    return out


def instances(raw: bytes, known: _Known | None) -> list[tuple[bytes, int, int]]:
    """(pattern, start, end) in bytes of every token, unwrapped, that stands in a known pattern (in any, without ``known``)."""
    out, hits = _labelled(raw, known), _hits(raw, known)
    spans = [m.span() for m in _TOKEN.finditer(raw)] if hits else []
    for pattern, i in hits:
        a, b = spans[i]
        a, b = b - len(raw[a:b].lstrip(_WRAP)), a + len(raw[a:b].rstrip(_WRAP))
        if a < b:
            out.append((pattern, a, b))
    return out


def seeds_of(text: str, raw: bytes, base) -> list[tuple[int, int]]:
    """Byte spans of the seed entities: the base spans, then secret-shaped runs apart from them."""
    chars = sorted({x for _, s, e in base for x in (s, e)})
    at = dict(zip(chars, _bytes_at(text, chars)))
    spans = [(at[s], at[e]) for _, s, e in base]
    return spans + [(s, e) for s, e in key_spans(raw) if not any(a < e and s < b for a, b in spans)]


def _bytes_at(text: str, chars: list[int]) -> list[int]:
    """Byte offsets of ascending character offsets."""
    if text.isascii():
        return chars
    out, last, n = [], 0, 0
    for c in chars:
        n += len(text[last:c].encode())
        last = c
        out.append(n)
    return out


_SPAN = "array<struct<kind:int,start:int,end:int>>"
#: Patterns and span-bearing texts are looked up in every task up to these many; beyond, by a join.
BROADCAST_PATTERNS, BROADCAST_TEXTS = 200_000, 1_000_000


def _keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text: equal texts have equal spans."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_EDGES = pa.list_(pa.struct([("pattern", pa.binary()), ("instance", pa.binary())]))
_SEARCHED = pa.struct([("base", _SPANS), ("edges", _EDGES)])


def _searched(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` as struct d, with the text's keys, base spans and the seeds' pattern edges. Only texts go to Python."""
    t = name(text_col).cast("string")

    def kernel(texts):
        spans, edges = [], []
        for t in texts.to_pylist():
            base, raw = base_spans(t or ""), (t or "").encode()
            spans.append([dict(zip(("kind", "start", "end"), x)) for x in base])
            edges.append([{"pattern": p, "instance": _instance(raw[s:e])} for s, e in seeds_of(t or "", raw, base) for p in patterns_of(raw, s, e)])
        return pa.StructArray.from_arrays([pa.array(spans, _SPANS), pa.array(edges, _EDGES)], fields=list(_SEARCHED))

    def searched(texts: pa.Array) -> pa.Array:
        return sliced(kernel, _SEARCHED, texts)

    # "not deterministic" keeps Spark from searching a text again for each field that is read
    search = F.arrow_udf(searched, f"base {_SPAN}, edges array<struct<pattern:binary,instance:binary>>").asNondeterministic()
    return docs.select(F.struct(*map(name, keep)).alias("d"), *_keys(t), search(t).alias("s")).select("d", "k1", "k2", "s.base", "s.edges")


def _frequencies(docs: DataFrame, text_col: str, patterns: DataFrame, few: bool) -> DataFrame:
    """(pattern, n): how many tokens stand in each pattern."""
    t = name(text_col).cast("string")
    shipped = docs.sparkSession.sparkContext.broadcast([bytes(r[0]) for r in patterns.select("pattern").collect()]) if few else None
    schema = pa.schema([("pattern", pa.binary()), ("n", pa.int64())])

    def kernel(batches):
        known = _Known(shipped.value) if shipped else None
        for b in bounded(batches, 0, rows=4096):
            counts: Counter = Counter()
            for t in b.column(0).to_pylist():
                raw = (t or "").encode()
                counts.update(p for p, _ in _hits(raw, known))
                counts.update(p for p, _, _ in _labelled(raw, known))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)

    return docs.select(t.alias("t")).mapInArrow(kernel, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, text_col: str, patterns: DataFrame, few: bool) -> DataFrame:
    """(k1, k2, pattern, instance, seed, start, end) wherever a pattern stands, in characters."""
    t = name(text_col).cast("string")
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast([bytes(r[0]) for r in patterns.select("pattern").collect()]) if few else None
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("pattern", pa.binary()), ("instance", pa.binary()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())])

    def kernel(batches):
        known = _Known(shipped.value) if shipped else None
        for b in bounded(batches, 2):
            rows = []
            for k1, k2, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = (t or "").encode()
                found = instances(raw, known)
                if not found:
                    continue
                base = base_spans(t)
                seeds, base = seeds_of(t, raw, base), len(base)
                places = sorted({x for _, s, e in found for x in (s, e)})
                chars = dict(zip(places, places if t.isascii() else _chars_at(raw, places)))
                starts = sorted((s, e, k) for k, (s, e) in enumerate(seeds))
                for p, s, e in found:
                    over = _overlapping(starts, s, e)
                    if not any(k < base for _, _, k in over):  # base spans are seeds already
                        rows.append((k1, k2, p, _instance(raw[s:e]), bool(over), chars[s], chars[e]))
                rows += [(k1, k2, p, _instance(raw[s:e]), True, None, None) for k, (s, e) in enumerate(seeds) for p in patterns_of(raw, s, e) if k < base]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    found = docs.select(*_keys(t), t.alias("t")).mapInArrow(kernel, "k1 long, k2 long, pattern binary, instance binary, seed boolean, start int, end int")
    return found if not few else found.join(F.broadcast(patterns.select("pattern")), "pattern", "left_semi")


def _chars_at(raw: bytes, places: list[int]) -> list[int]:
    out, last, n = [], 0, 0
    for p in places:
        n += len(raw[last:p].decode())
        last = p
        out.append(n)
    return out


def _overlapping(spans: list[tuple[int, int, int]], start: int, end: int) -> list[tuple[int, int, int]]:
    """Those of the sorted, mostly disjoint spans that meet [start, end)."""
    at, out = bisect_left(spans, (end,)), []
    while at and len(out) < 8:
        at -= 1
        if spans[at][1] > start:
            out.append(spans[at])
        elif start - spans[at][0] > 64 + end - start:
            break
    return out


def _reliable(places: DataFrame, rounds: int, reliable: float, support: int) -> DataFrame:
    """(pattern, p, k): the patterns that may name new identifiers."""
    e = scratch(places.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    seeds = e.where("seed").select("instance").distinct().withColumn("known", F.lit(True))
    e = scratch(e.drop("seed").join(seeds, "instance", "left").select("pattern", "instance", F.col("known").isNotNull().alias("seed"), F.when(F.col("known"), 1.0).otherwise(0.0).alias("conf")), "edges")
    score = lambda x: x.groupBy("pattern").agg((F.sum("conf") / (F.count("*") + 1)).alias("p"), F.count("*").alias("k"))
    for _ in range(rounds - 1):
        best = e.where("not seed").join(score(e), "pattern").groupBy("instance").agg(F.max(F.when(F.col("k") >= support, F.col("p")).otherwise(0.0)).alias("best"))
        e = scratch(e.select("pattern", "instance", "seed").join(best, "instance", "left").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("best")).alias("conf")), "edges")
    return scratch(score(e).where(f"k >= {support} and p >= {reliable}"), "reliable")


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rounds: int = 3, reliable: float = 0.7, support: int = 5, promise: float = 0.1) -> DataFrame:
    """``d`` (columns ``keep`` of ``docs``, or all) with ``base`` and ``spans``: arrays of (kind number, start, end), sorted."""
    s = scratch(_searched(docs, text_col, docs.columns if keep is None else keep), "pii")
    stands = s.select(F.explode("edges").alias("e")).groupBy("e.pattern", "e.instance").agg(F.count("*").alias("n"))
    induced = scratch(stands.groupBy("pattern").agg(F.count("*").alias("seeds"), F.sum("n").alias("stands")).where(F.col("seeds") >= support), "patterns")
    of_all = _frequencies(docs, text_col, induced, induced.count() <= BROADCAST_PATTERNS)
    every, induced = induced, scratch(induced.join(of_all, "pattern", "left").where(F.col("stands") >= promise * F.coalesce("n", F.lit(0))).select("pattern"), "patterns")
    few = induced.count() <= BROADCAST_PATTERNS
    places = _places(docs, text_col, induced, few)
    places = scratch(places if few else places.join(induced.select("pattern"), "pattern", "left_semi"), "places")
    good = _reliable(places, rounds, reliable, support).select("pattern")
    good = F.broadcast(good) if good.count() <= BROADCAST_PATTERNS else good
    new = places.where("start is not null").join(good, "pattern", "left_semi").select("k1", "k2", "start", "end").distinct()
    new = scratch(new.groupBy("k1", "k2").agg(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end")).alias("new")), "new")
    discard(every, induced, places)
    new = F.broadcast(new) if new.count() <= BROADCAST_TEXTS else new
    both = F.concat("base", F.coalesce("new", F.array().cast(_SPAN)))
    return s.join(new, ["k1", "k2"], "left").select("d", F.array_sort("base").alias("base"), F.array_sort(both).alias("spans"))


def rendered(spans):
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])))


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in angle brackets; overlapping spans merge."""
    found = find(docs, text_col, **options).select("d", F.col("d").getField(text_col).cast("string").alias("t"), "spans")

    def clean(text, spans):
        if text is None or not spans:
            return text
        out, end = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= end:
                out += [text[end : s["start"]], f"<{KINDS[s['kind']]}>"]
            end = max(end, s["end"])
        return "".join([*out, text[end:]])

    def kernel(texts, spans):
        return pa.array([clean(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    def cleaned(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return sliced(kernel, pa.string(), texts, spans)

    # only texts with spans go to Python
    replace = F.arrow_udf(cleaned, "string").asNondeterministic()
    done = found.select("d", F.coalesce(replace(F.when(F.size("spans") > 0, F.col("t")), "spans"), "t").alias("t"))
    return done.select(*(F.col("t").alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in docs.columns))
