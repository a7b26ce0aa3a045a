"""Counts, identifiers, search, streams and the registered queries."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexmill.functions.tokens import TokenSpec
from lexmill.operators import counts as C
from lexmill.operators.search import search, terms_frame
from lexmill.operators.text import sentences, tokens, types_of
from lexmill.plans import queries as queries_module
from lexmill.streaming.counts import stream_census


def test_census(spark):
    df = spark.createDataFrame([(0, "a", 2.0), (1, "b", -1.0), (2, "a", 8.0), (3, "b", 1.0)], "ord int, type string, w double")
    assert [tuple(r)[:2] for r in C.census_sorted(C.census(df, weight="w", order=["ord"])).collect()] == [("a", 10.0), ("b", 0.0)]
    with pytest.raises(Exception, match="NaN"):
        C.census(spark.createDataFrame([("a", float("nan"))], "type string, w double"), weight="w").collect()
    rose = spark.createDataFrame([("A rose is a rose is a rose.",)], "text string")
    assert [(r["item"], r.weight) for r in C.census_sorted(C.census(tokens(rose), order=["pos"])).collect()] == [("a", 3), ("rose", 3), ("is", 2), (".", 1)]


def test_ngrams(spark):
    docs = spark.createDataFrame([("a a a b a b".split(),), (["z"],), ([],), (None,)], "types array<string>")
    got = {" ".join(r.ngram): r.weight for r in C.ngrams(docs, 2).collect()}
    assert got == {"a": 4, "a a": 2, "b": 2, "a b": 2, "b a": 1, "z": 1}
    rng = random.Random(1)
    seq = [(str(rng.randrange(10)), float(rng.randrange(3))) for _ in range(2000)]
    want = Counter()
    for n in (1, 2, 3):
        for i in range(len(seq) - n + 1):
            want[tuple(x for x, _ in seq[i : i + n])] += seq[i + n - 1][1]
    df = spark.createDataFrame([(seq,)], "items array<struct<type:string,weight:double>>")
    assert {tuple(r.ngram): r.weight for r in C.weighted_ngrams(df, 3).collect()} == dict(want)


def test_identifiers(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(300)) for i in range(3000)]
    want = {x: k for k, x in enumerate(dict.fromkeys(x for _, x in rows))}
    df = spark.createDataFrame(rows, "ord int, item int")
    assert {r["item"]: r.id for r in C.distinct_ids(df, "item", ["ord"]).collect()} == want
    assert C.distinct_ids(df.limit(0), "item", ["ord"]).count() == 0


def test_search(spark):
    def found(text, *terms):
        df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
        rows = search(df, terms_frame(spark, list(terms)))
        return [(r.term, r.start, r.size) for r in rows.orderBy("end_pos", F.desc("length")).collect()]

    assert found("a b c a a", "a") == [("a", 0, 1), ("a", 6, 1), ("a", 8, 1)]
    assert found("b a b c a b a", "a b") == [("a b", 2, 3), ("a b", 8, 3)]
    assert found("c b a b a b b b c", "a b", "a", "b") == [("b", 2, 1), ("a", 4, 1), ("a b", 4, 3), ("b", 6, 1), ("a", 8, 1), ("a b", 8, 3), ("b", 10, 1), ("b", 12, 1), ("b", 14, 1)]
    assert found("a b c", "a b", "b c") == [("a b", 0, 3), ("b c", 2, 3)]
    with pytest.raises(ValueError):
        terms_frame(spark, ["  "])


def test_text_rows(spark):
    df = spark.createDataFrame([(1, "Hi! Yo."), (2, ""), (3, None)], "id int, text string")
    assert [(r.id, r.pos, r.sentence) for r in sentences(df).orderBy("id", "pos").collect()] == [(1, 0, "Hi! "), (1, 1, "Yo."), (2, 0, "")]
    assert [tuple(r) for r in tokens(df, spec=TokenSpec(drop_classes=("punct",)), keep_dropped=True).orderBy("pos").collect()][1] == (1, 1, 2, 1, "!", None, "punct")
    plan = df.select("id", F.explode(types_of(F.col("text"))).alias("t")).where("t <> 'x'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a b a",), ("b c",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = stream_census(spark.readStream.schema("text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {r["item"]: r.weight for r in spark.table("counted").collect()} == {"a": 2, "b": 2, "c": 1}


def test_search_both_ways(spark, monkeypatch):
    """Beyond the broadcast bound the join finds what the trie does."""
    df = spark.createDataFrame([(1, "a b a b c. b a"), (2, ""), (3, None)], "id int, text string")
    terms = terms_frame(spark, ["a", "a b", "b a b", "b c", "c b"])
    few = sorted(tuple(r) for r in search(df, terms).collect())
    monkeypatch.setattr("lexmill.operators.search.BROADCAST_TERMS", 1)
    assert few == sorted(tuple(r) for r in search(df, terms).collect()) and len(few) == 7


def test_trees(spark):
    docs = spark.createDataFrame([(["b", "a"],), (["b", "a", "c"],), (["a", "z"],), (["b", "b"],), ([],), (None,)], "types array<string>")
    rows = C.numbered_tree(C.prefix_tree(docs, "types")).orderBy("id").collect()
    assert [(r.id, r.parent_id, r.depth, r["item"]) for r in rows] == [(0, None, 1, "a"), (1, None, 1, "b"), (2, 0, 2, "z"), (3, 1, 2, "a"), (4, 1, 2, "b"), (5, 3, 3, "c")]
    assert C.numbered_tree(C.prefix_tree(docs.limit(0), "types")).count() == 0
    ids = spark.createDataFrame([(30, 0), (10, 1), (20, 2)], "item int, id long")
    assert [tuple(r) for r in C.sorted_ids(ids).orderBy("rank").collect()] == [(10, 1, 0), (20, 2, 1), (30, 0, 2)]


CORE = sorted(queries_module.SQL)


@pytest.mark.parametrize("name", CORE)
def test_sql(spark, name):
    """Each of the engine's own queries against its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries_module.QUERIES[name](spark, sf), con.sql(queries_module.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows, cols: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert key([tuple(r) for r in got.collect()], got.columns) == key(want.fetchall(), want.columns)


def test_registry(spark):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and set(queries_module.SQL) == set(queries_module.QUERIES) and {"term_census", "event_search", "json_get_k"} <= set(names)
    assert __spark_entry__.entry(spark).columns == ["item", "n"]
