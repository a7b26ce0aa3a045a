"""Counting: census, n-grams of every length, vocabularies and dense identifiers.

All are partial and final hash aggregates; nothing is gathered per document except the order of
its own tokens.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import TokenSpec
from ..sources.saved import saved
from .text import counted_runs


def _weight(weight: str | Column | float) -> Column:
    w = F.col(weight) if isinstance(weight, str) else weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.when(F.isnan(w.cast("double")), F.raise_error(F.lit("a weight is NaN"))).otherwise(w.cast("double"))


def census(df: DataFrame, item: str = "type", weight: str | Column | float = 1.0, order: list[str] | None = None) -> DataFrame:
    """(item, weight[, first_seen]): summed weights, negative ones allowed, zero sums kept, NaN an error.

    ``order`` names the columns that give the order of arrival; ``first_seen`` is their least struct.
    """
    first = [F.min(F.struct(*order)).alias("first_seen")] if order else []
    return df.groupBy(F.col(item).alias("item")).agg(F.sum(_weight(weight)).alias("weight"), *first)


def census_sorted(counted: DataFrame, k: int | None = None) -> DataFrame:
    """By weight descending, then first seen (or item); the ``k`` first if asked for."""
    out = counted.orderBy(F.desc("weight"), "first_seen" if "first_seen" in counted.columns else "item")
    return out if k is None else out.limit(k)


def type_arrays(tok: DataFrame, doc: list[str], pos: str = "pos", item: str = "type") -> DataFrame:
    """(doc columns, types): each document's items in order, from rows."""
    return tok.groupBy(*doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, item))), lambda s: s[item]).alias("types"))


def grams(types: Column, n: int, exact: bool = False) -> Column:
    """Array of all runs of length 1..n (or n only) of an array."""
    return F.concat(*(_runs(types, k) for k in ([n] if exact else range(1, n + 1))))


def _runs(types: Column, k: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(types) - (k - 1)), lambda i: F.slice(types, i, k))
    return F.when(F.size(types) >= k, runs).otherwise(F.array().cast("array<array<string>>"))


def ngrams(docs: DataFrame, n: int, types: str = "types", weight: str | Column | float = 1.0, exact: bool = False) -> DataFrame:
    """(ngram, length, weight): frequencies of all n-grams up to length n; none crosses a document.

    ``weight`` is per document; see ``weighted_ngrams`` for weights per item.
    """
    each = docs.select(F.explode(grams(F.col(types), n, exact)).alias("ngram"), _weight(weight).alias("w"))
    return each.groupBy("ngram").agg(F.sum("w").alias("weight")).select("ngram", F.size("ngram").alias("length"), "weight")


def text_ngrams(df: DataFrame, n: int, text: str = "text", spec: TokenSpec = TokenSpec()) -> DataFrame:
    """As ``ngrams`` over the types of texts, counted by parts of a partition first; they travel as strings."""
    each = counted_runs(df, n, text, spec).groupBy("run", "length").agg(F.sum(_weight("n")).alias("weight"))
    return each.select(F.split("run", "\n").alias("ngram"), "length", "weight")


def weighted_ngrams(docs: DataFrame, n: int, items: str = "items") -> DataFrame:
    """As ``ngrams`` over arrays of (type, weight); an n-gram weighs what its last item does."""
    a = F.col(items)

    def runs(k: int) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(a) - (k - 1)), lambda i: F.struct(F.transform(F.slice(a, i, k), lambda s: s["type"]).alias("ngram"), F.element_at(a, i + (k - 1))["weight"].cast("double").alias("w")))
        return F.when(F.size(a) >= k, run).otherwise(F.array().cast("array<struct<ngram:array<string>,w:double>>"))

    each = docs.select(F.inline(F.concat(*(runs(k) for k in range(1, n + 1)))))
    return each.groupBy("ngram").agg(F.sum(_weight("w")).alias("weight")).select("ngram", F.size("ngram").alias("length"), "weight")


def ngram_sorted(counted: DataFrame) -> DataFrame:
    """Breadth first: by length, then by the items from the last to the first."""
    return counted.orderBy("length", F.reverse("ngram"))


def _nodes(sequence: Column) -> Column:
    """ARRAY<STRUCT<depth, parent, node, item>> of the prefixes; a node is a running 128-bit hash, so a long sequence costs one struct per item."""
    of = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("parent", T.BinaryType()), T.StructField("node", T.BinaryType()), T.StructField("item", T.StringType())])

    @F.arrow_udf(T.ArrayType(of))
    def kernel(sequences: pa.Array) -> pa.Array:
        out = []
        for items in sequences.to_pylist():
            run, parent, nodes = blake2b(digest_size=16), None, []
            for depth, x in enumerate(items or (), 1):
                raw = x.encode()
                run.update(len(raw).to_bytes(8, "little") + raw)
                node = run.digest()
                nodes.append({"depth": depth, "parent": parent, "node": node, "item": x})
                parent = node
            out.append(nodes)
        return pa.array(out, pa.list_(pa.struct([("depth", pa.int32()), ("parent", pa.binary()), ("node", pa.binary()), ("item", pa.string())])))

    return kernel.asNondeterministic()(sequence.cast("array<string>"))


def prefix_tree(sequences: DataFrame, key: str) -> DataFrame:
    """(node, parent, depth, item): every distinct prefix of the arrays in ``key``, by hash, with the prefix it lengthens and its last item; NULL parent at depth 1."""
    return sequences.select(F.inline(_nodes(F.col(key)))).groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("item").alias("item"))


def numbered_tree(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, parent, depth, item, id, parent_id): nodes numbered from 0 breadth first, by depth, then the parent's number, then the item.

    One join and one ranking per level; levels are found by one aggregate.
    """
    last = nodes.agg(F.max("depth")).first()[0] or 0
    last = min(last, max_depth) if max_depth else last
    done, above, before = [], None, 0
    for depth in range(1, last + 1):
        level = nodes.where(F.col("depth") == depth)
        level = level.withColumn("parent_id", F.lit(None).cast("long")) if above is None else level.join(above.select(F.col("node").alias("parent"), F.col("id").alias("parent_id")), "parent")
        above = saved(_dense(level, ["parent_id", "item"], before).select("node", "parent", "depth", "item", "id", "parent_id"))
        before += above.count()
        done.append(above)
    if not done:
        return nodes.select("node", "parent", "depth", "item", F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id")).limit(0)
    return reduce(DataFrame.unionByName, done)


def vocabulary(tok: DataFrame, type_: str = "type", token: str = "token") -> DataFrame:
    """(type, tokens): the distinct surface forms of each type, sorted."""
    return tok.select(type_, token).distinct().groupBy(F.col(type_).alias("type")).agg(F.array_sort(F.collect_list(token)).alias("tokens"))


def _dense(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """``rows`` with ``id``: dense numbers in the given order, which must be without ties.

    Rows are parted by ranges of the order and written down with their part, so that the parts
    counted are the parts ranked; one count per part is summed up, and no task ranks all rows.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = saved(saved(rows).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranked.withColumn("_nth", nth).join(F.broadcast(offsets), "_part").withColumn("id", (F.col("_nth") + F.col("_before") - 1 + start).cast("long")).drop("_part", "_nth", "_before")


def distinct_ids(df: DataFrame, item: str, order: list[str]) -> DataFrame:
    """(item, id): distinct items (also arrays: sequences) with dense ids from 0 in order of first appearance."""
    first = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.min(F.struct(*order)).alias("first"))
    return _dense(first, ["first", "item"]).select("item", "id")


def sorted_ids(ids: DataFrame) -> DataFrame:
    """(item, id, rank): a set with ids in ascending order of its items, the ids carried along; rank from 0."""
    return _dense(ids.withColumnRenamed("id", "old"), ["item"]).select("item", F.col("old").alias("id"), F.col("id").alias("rank"))


def having(df: DataFrame, items: DataFrame, on: list[str], present: bool = True) -> DataFrame:
    """Rows of ``df`` whose key is (or isn't) among ``items``: a semi or anti join."""
    return df.join(items.select(*on).distinct(), on, "left_semi" if present else "left_anti")
