"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame operations only.

Sections are parted by an empty line, paragraphs by a line break. A paragraph's leaves are cut by
their content: each ends after the next mark that a space follows, so that an insertion shifts
none of the leaves after it; between two such places a longer run is cut every ``piece`` code
points. Joining them gives the text again, so equal roots mean
equal texts. A node's hash is the MD5 of its children's, the root SHA-256. The fingerprint holds
the root and the shortened hashes of all nodes in the tree's shape. Roots test equality; where
roots differ, ``changed_branches`` descends to the sections and paragraphs that were changed,
moved, inserted or deleted. Likeness is 1 for equal roots, else the Dice share of distinct leaves,
0 where neither has any.

The next document is the one with the next smaller id (after the smallest: the largest). Ids
are cut into runs of 64 consecutive values; a run is one window, and the last of each run takes
its text from the run that follows, found on run numbers alone in three levels of at most 2**20
values each. So no window holds more than 64 ids (rows that repeat one id share a window), texts are shuffled once by run and once
more for one in 64, and each text's fingerprint is made once, for itself and as the next one's.

Defined cases: null text is empty; null ids come after all others, ordered and parted by the
hash of their text; rows that repeat an id are ordered by the hash of their text; a single row is
its own next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import name


#: A leaf ends after a mark and a space, wherever it began, or after ``piece`` code points.
CUT = "[.;:!?] "


def tree(text: Column, piece: int = 192) -> Column:
    """Leaf hashes by section and paragraph."""
    whole = lambda x: F.when(F.char_length(x) <= piece, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)))
    leaves = lambda p: F.transform(F.flatten(F.transform(F.array_remove(F.split(p, f"(?<={CUT})"), ""), whole)), lambda x: F.md5(x))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def _let(value: Column, f) -> Column:
    """``f(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def nodes(t: Column) -> Column:
    """(h, r) of each section: its hash, and its paragraphs' hashes and leaves as text. Keep it in a column of its own, so that it is computed once."""
    node = lambda hashes: F.md5(F.concat_ws("", hashes))
    short = lambda p: F.concat_ws("", F.transform(p, lambda x: F.substring(x, 1, 8)))
    paragraph = lambda p: _let(node(p), lambda h: F.struct(h.alias("h"), F.concat(F.substring(h, 1, 16), F.lit("."), short(p)).alias("r")))
    section = lambda ps: F.struct(node(F.transform(ps, lambda p: p["h"])).alias("h"), F.concat_ws(",", F.transform(ps, lambda p: p["r"])).alias("r"))
    return F.transform(t, lambda s: _let(F.transform(s, paragraph), section))


def rendered(n: Column) -> Column:
    """root/section:paragraph.leaves,paragraph.leaves;section:... with the inner nodes' hashes cut to 16 digits, the leaves' to 8."""
    root = F.sha2(F.concat_ws("", F.transform(n, lambda s: s["h"])), 256)
    return F.concat_ws("/", root, F.concat_ws(";", F.transform(n, lambda s: F.concat(F.substring(s["h"], 1, 16), F.lit(":"), s["r"]))))


def leaves(fingerprint: Column) -> Column:
    """Distinct shortened leaves of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.substring_index(fingerprint, "/", -1), "[0-9a-f]{16}[:.]|[,;]", ""), F.lit(".{8}"), F.lit(0)))


def _shared(x: Column, y: Column) -> Column:
    """Dice share of two arrays of distinct leaves. Keep them in columns or variables, so that each is computed once."""
    n = F.size(x) + F.size(y)
    return F.when(n == 0, 0.0).otherwise(F.round(2 * F.size(F.array_intersect(x, y)) / n, 6))


def _distinct(t: Column) -> Column:
    """Distinct shortened leaves of a tree."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(t)), lambda x: F.substring(x, 1, 8)))


def likeness(a: Column, b: Column) -> Column:
    shared = _let(F.struct(leaves(a).alias("x"), leaves(b).alias("y")), lambda v: _shared(v["x"], v["y"]))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(shared)


def _sections(fingerprint: Column) -> Column:
    return F.split(F.substring_index(fingerprint, "/", -1), ";")


def _paragraphs(section: Column) -> Column:
    return F.split(F.substring_index(section, ":", -1), ",")


def _alike(x: Column, y: Column) -> Column:
    """How many of the first children of two nodes are equal."""
    n = F.least(F.size(x), F.size(y))
    return _let(F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: a == b), F.lit(False)), lambda at: F.when(at == 0, n).otherwise((at - 1).cast("int")))


def _between(x: Column, y: Column) -> Column:
    """Struct (skipped, x, y): the children without the equal ones at the start and at the end."""
    cut = lambda v, p: F.struct(p.alias("skipped"), F.slice(v["x"], p + 1, F.size(v["x"]) - p).alias("x"), F.slice(v["y"], p + 1, F.size(v["y"]) - p).alias("y"))
    end = lambda v, n: F.struct(v["skipped"].alias("skipped"), F.slice(v["x"], F.lit(1), F.size(v["x"]) - n).alias("x"), F.slice(v["y"], F.lit(1), F.size(v["y"]) - n).alias("y"))
    both = F.struct(x.alias("x"), y.alias("y"))
    return _let(_let(both, lambda v: _let(_alike(v["x"], v["y"]), lambda p: cut(v, p))), lambda v: _let(_alike(F.reverse(v["x"]), F.reverse(v["y"])), lambda n: end(v, n)))


_BRANCH = "array<struct<side:string,change:string,section:int,paragraph:int>>"


def changed_branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ, found by descent from the roots: an array of (side, change, section, paragraph), numbers from 0.

    Equal roots give none. Sections between the equal ones at both ends are compared: one that the
    other side has there too is ``moved``; the others are paired in order. Within a pair the
    paragraphs between the equal ones at both ends are ``changed``, each on its own side; a section
    without partner is ``deleted`` (side a) or ``inserted`` (side b), as a whole (paragraph null).
    """
    row = lambda side, change, section, paragraph: F.struct(F.lit(side).alias("side"), F.lit(change).alias("change"), section.cast("int").alias("section"), paragraph.cast("int").alias("paragraph"))
    none = F.lit(None)
    numbered = lambda v, side: F.transform(v[side], lambda s, i: F.struct((i + v["skipped"]).alias("i"), s.alias("s")))

    def inner(x: Column, y: Column) -> Column:
        here = lambda v, side, at, number: F.transform(v[side], lambda p, i: row(at, "changed", number, i + v["skipped"]))
        return _let(_between(_paragraphs(x["s"]), _paragraphs(y["s"])), lambda v: F.concat(here(v, "x", "a", x["i"]), here(v, "y", "b", y["i"])))

    def outer(v: Column) -> Column:
        moved = lambda mine, other, at: F.transform(F.filter(numbered(v, mine), lambda s: F.array_contains(v[other], s["s"])), lambda s: row(at, "moved", s["i"], none))
        alone = lambda mine, other: F.filter(numbered(v, mine), lambda s: ~F.array_contains(v[other], s["s"]))

        def paired(u: Column) -> Column:
            n = F.least(F.size(u["x"]), F.size(u["y"]))
            rest = lambda c, at, change: F.transform(F.slice(c, n + 1, F.size(c)), lambda s: row(at, change, s["i"], none))
            within = F.flatten(F.zip_with(F.slice(u["x"], F.lit(1), n), F.slice(u["y"], F.lit(1), n), inner))
            return F.concat(within, rest(u["x"], "a", "deleted"), rest(u["y"], "b", "inserted"))

        return F.concat(moved("x", "y", "a"), moved("y", "x", "b"), _let(F.struct(alone("x", "y").alias("x"), alone("y", "x").alias("y")), paired))

    found = _let(_between(_sections(a), _sections(b)), outer)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast(_BRANCH)).otherwise(found.cast(_BRANCH))


def first_difference(a: Column, b: Column) -> Column:
    """Struct (section, paragraph) of the first branch where two fingerprints differ; null for equal roots."""
    found = _let(F.struct(_sections(a).alias("x"), _sections(b).alias("y")), lambda v: _let(_alike(v["x"], v["y"]), lambda p: F.struct(p.cast("long").alias("section"), _alike(_paragraphs(F.coalesce(F.get(v["x"], p), F.lit(""))), _paragraphs(F.coalesce(F.get(v["y"], p), F.lit("")))).cast("long").alias("paragraph"))))
    return F.when(F.substring(a, 1, 64) != F.substring(b, 1, 64), found)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = 192) -> DataFrame:
    """One row per document: doc_id, fingerprint."""
    return docs.select(name(id_col).alias("doc_id"), tree(F.coalesce(name(text_col), F.lit("")), piece).alias("t")).select("doc_id", nodes(F.col("t")).alias("n")).select("doc_id", rendered(F.col("n")).alias("fingerprint"))


def _following(runs: DataFrame) -> DataFrame:
    """(run, next_run) of distinct run numbers in descending order, the last followed by the first."""
    cut = 20
    runs = runs.withColumn("g", F.shiftright("run", cut))
    tops = runs.groupBy("g").agg(F.max("run").alias("top")).withColumn("gg", F.shiftright("g", cut))
    higher = tops.groupBy("gg").agg(F.max("top").alias("top"))  # at most 2**18 rows: run numbers have 58 bits
    everything = Window.partitionBy(F.lit(0)).orderBy(F.desc("gg"))
    higher = higher.select("gg", F.coalesce(F.lead("top").over(everything), F.first("top").over(everything)).alias("next_gg"))
    tops = tops.withColumn("next", F.lead("top").over(Window.partitionBy("gg").orderBy(F.desc("g")))).join(higher, "gg").select("g", F.coalesce("next", "next_gg").alias("next_g"))
    return runs.withColumn("next", F.lead("run").over(Window.partitionBy("g").orderBy(F.desc("run")))).join(tops, "g").select("run", F.coalesce("next", "next_g").alias("next_run"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = 192) -> DataFrame:
    """One row per document: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, first_edit."""
    i, t = name(id_col).cast("long"), F.coalesce(name(text_col).cast("string"), F.lit(""))
    tie = F.xxhash64(t)
    run = F.coalesce(F.shiftright(i, 6), F.lit(-(1 << 57) - 1) - F.shiftrightunsigned(tie, 48)).alias("run")
    order = [F.desc_nulls_last("doc_id"), F.desc("tie")]
    within = Window.partitionBy("run").orderBy(*order)
    # the only shuffle of the texts: what follows on them is by run
    base = docs.select(i.alias("doc_id"), t.alias("text"), run, tie.alias("tie")).repartition("run").sortWithinPartitions("run", *order)

    def printed(rows: DataFrame, text: str, *keep: str) -> DataFrame:
        """``keep`` and fingerprint f, root r and distinct leaves l of a text, each computed once."""
        n = rows.select(*keep, tree(F.col(text), piece).alias("tree")).select(*keep, nodes(F.col("tree")).alias("n"), _distinct(F.col("tree")).alias("l"))
        return n.select(*keep, rendered(F.col("n")).alias("f"), "l").select(*keep, "f", "l", F.substring("f", 1, 64).alias("r"))

    heads = printed(base.withColumn("nth", F.row_number().over(within)).where("nth = 1"), "text", "run", "text").select(F.col("run").alias("next_run"), F.col("text").alias("head"), F.col("l").alias("head_l"), F.col("r").alias("head_r"))
    heads = _following(docs.select(run, i.alias("x")).select("run").distinct()).join(heads, "next_run").drop("next_run")
    inner = printed(base, "text", "doc_id", "tie", "text", "run").withColumns({f"next_{c}": F.lead(c).over(within) for c in ("text", "l", "r")})
    pairs = inner.join(heads, "run").select("doc_id", "text", F.coalesce("next_text", "head").alias("next"), "f", "l", "r", *(F.coalesce(f"next_{c}", f"head_{c}").alias(f"next_{c}") for c in "lr"))
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    d = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next"), F.lit(1), k)).alias("edited"), F.col("f").alias("fingerprint"), *(F.col(c).alias(f"own_{c}") for c in "lr"), "next_l", "next_r")
    d = printed(d, "edited", *d.columns)
    like = lambda side: F.when(F.col("own_r") == F.col(f"{side}r"), 1.0).otherwise(_shared(F.col("own_l"), F.col(f"{side}l")))
    d = d.select("doc_id", "n_chars", "edited", "fingerprint", F.col("f").alias("edited_fingerprint"), like("").alias("near_edited"), like("next_").alias("near_next"))
    return d.select("*", first_difference(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_edit"))
