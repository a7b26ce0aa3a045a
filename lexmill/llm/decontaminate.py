"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Masks of ``1`` (compared) and ``0`` (ignored) positions are laid over every position of
a text; the words under the ones are hashed. Seeds of all documents are joined to those of the
benchmark items; hits on one diagonal (document position minus item position) are one
alignment. Around its hits an alignment is verified word by word: a window of
min(item length, ``window``) words in which at least ``share`` of the words agree in place
shows a contamination, whatever single words were substituted.

No such window goes without a seed. For each window length that items have, the given masks are
used if every pattern of allowed substitutions leaves one of them untouched somewhere in the
window (``covers``); if not, a run of words is used instead: ``e`` substitutions in ``m`` words
always leave floor(m / (e + 1)) words in a row untouched. Items of up to four words must be whole
by default. Masks are laid over the documents only if the lengths of the items call for them.

Benchmark seeds are broadcast only if they are counted at most ``broadcast_rows``; beyond that
the join is left to the optimizer. The alignments found are written down and counted: up to
``broadcast_rows`` of them are broadcast to the documents, whose texts then never move; more are
joined by document, which shuffles the words of all documents once.

Defined cases: null and empty texts match nothing, nor do items without words; words are lower-cased letter-digit runs; rows that repeat an
id are judged by their own texts; null ids stay null; repeated items count once each; empty
tables on either side give every document clean; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import name
from .native import words
from .scratch import scratch

#: Together these two meet every window of 13 words with up to two substitutions (``covers``); no single mask of six words does.
MASKS = ("1111011", "110010111")


def allowed(size: int, share: float) -> int:
    """The most words of a window of ``size`` that may be substituted; at least one word must agree."""
    return max(e for e in range(size) if e == 0 or (size - e) / size >= share)


@cache
def covers(masks: tuple[str, ...], size: int, changes: int) -> bool:
    """Whether any ``changes`` substitutions in a window of ``size`` words leave some mask untouched somewhere (False if the patterns are too many to try)."""
    if comb(size, changes) > 20_000:
        return False
    laid = {sum(1 << (i + j) for j, c in enumerate(m) if c == "1") for m in masks for i in range(size - len(m) + 1)}
    return all(any(not x & sum(1 << k for k in gone) for x in laid) for gone in combinations(range(size), changes))


def masks_for(size: int, share: float, masks=MASKS) -> tuple[str, ...]:
    """Masks that together meet every window of ``size`` words that agrees in ``share`` of them."""
    e = allowed(size, share)
    return tuple(masks) if covers(tuple(masks), size, e) else ("1" * (size // (e + 1)),)


def _seeds(rows: DataFrame, w: str, masks, sizes: dict | None = None, size=None) -> DataFrame:
    """The other columns of ``rows`` with (pos, seed), a row per position of the words ``w`` and mask; the mask is hashed too.

    With ``sizes``, a mask is laid only where ``size`` is one of its sizes. Positions are exploded
    before anything is hashed, so the hashing is compiled with the rest of the stage.
    """
    n = F.size(w)

    def laid(number: int, mask: str):
        seed = F.xxhash64(F.lit(number), *(F.get(w, F.col("pos") + j) for j, c in enumerate(mask) if c == "1"))
        here = F.col("pos") + len(mask) <= n
        return F.when(here & size.isin(sizes[mask]) if sizes else here, seed)

    others = [c for c in rows.columns if c != w]
    each = rows.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return each.select(*others, "pos", F.explode(F.array(*(laid(k, m) for k, m in enumerate(masks)))).alias("seed")).where("seed is not null")


def alignments(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, share: float, masks, broadcast_rows: int) -> DataFrame:
    """(doc_id, tie, item_id, start, agree): verified alignments, agree being the best window's share."""
    b = items.select(name(item_col).alias("item_id"), words(name(item_text_col)).alias("bw")).where(F.size("bw") > 0)
    b = b.withColumn("item", F.xxhash64("item_id", "bw"))
    size = F.least(F.size("bw"), F.lit(window))
    sizes: dict[str, list[int]] = {}
    for r in b.select(size.alias("size")).distinct().collect():  # at most ``window`` rows
        for mask in masks_for(r["size"], share, masks):
            sizes.setdefault(mask, []).append(r["size"])
    laid = sorted(sizes) or ["1"]
    seeds = scratch(_seeds(b.select("item", size.alias("size"), "bw"), "bw", laid, sizes, F.col("size")).select("item", F.col("pos").alias("ipos"), "seed").distinct(), "seeds")
    if seeds.count() <= broadcast_rows:
        seeds = F.broadcast(seeds)
    d = docs.select(name(id_col).alias("doc_id"), F.xxhash64(name(text_col)).alias("tie"), name(text_col).cast("string").alias("text"))
    hits = _seeds(d.select("doc_id", "tie", words(F.col("text")).alias("w")), "w", laid).join(seeds, "seed")
    hits = scratch(hits.groupBy("doc_id", "tie", "item", (F.col("pos") - F.col("ipos")).alias("start")).agg(F.count("*").alias("hits")), "hits")
    few = hits.count() <= broadcast_rows
    met = d.alias("d").join((F.broadcast(hits) if few else hits).alias("h"), F.col("h.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("h.tie") == F.col("d.tie"))).select("h.doc_id", "h.tie", "item", "start", "hits", words(F.col("text")).alias("dw"))
    # only the words under the item are carried on
    lengths = b.select("item", F.size("bw").alias("m")).distinct()
    met = met.join(lengths, "item").select("doc_id", "tie", "item", "start", "hits", F.slice("dw", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("m") + F.least(F.col("start"), F.lit(0))).alias("part"), F.greatest(-F.col("start"), F.lit(0)).alias("lead"))
    met = met.join(b.select("item", "item_id", "bw").distinct(), "item")
    same = F.transform("bw", lambda x, i: F.when(F.get("part", i - F.col("lead")).eqNullSafe(x) & (i >= F.col("lead")), 1).otherwise(0))
    met = met.withColumn("same", same).withColumn("size", F.least(F.size("bw"), F.lit(window)))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("size") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("size")), F.lit(0), lambda a, x: a + x)))
    return met.withColumn("agree", best / F.col("size")).where(F.col("agree") >= share).select("doc_id", "tie", "item_id", "start", F.round("agree", 6).alias("agree"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: float = 0.8, masks=MASKS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, tie (hash of its text), n_items, items (sorted ids), agree, contaminated."""
    found = alignments(docs, items, id_col, text_col, item_col, item_text_col, window, share, masks, broadcast_rows)
    found = found.groupBy(F.col("doc_id").alias("found_id"), F.col("tie").alias("found_tie")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("agree").alias("agree"))
    every = docs.select(name(id_col).alias("doc_id"), F.xxhash64(name(text_col)).alias("tie"))
    out = every.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("tie") == F.col("found_tie")), "left")
    n = F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long")
    return out.select("doc_id", "tie", n.alias("n_items"), "items", F.coalesce("agree", F.lit(0.0)).alias("agree"), F.col("items").isNotNull().alias("contaminated"))
