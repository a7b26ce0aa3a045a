"""The engine's own queries over the driver's tables, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import TokenSpec
from ..operators import counts as C
from ..operators.search import BROADCAST_TERMS, occurrences, search, terms_frame
from ..operators.text import counted_runs, first_places, sentences, spread, tokens, types_of
from ..resources import stopwords, suppressions
from ..sources import ndjson
from . import json_queries, sentence_sql, stem_sql, text_queries

_TEXTS = {"documents": ["doc_id", "text"], "benchmark": ["item_id", "text"], "conversations": ["conv_id", "turn", "text"]}


def _T(spark, d, name):
    t = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(t.select(*_TEXTS[name])) if name in _TEXTS else t


ENGLISH = tuple(stopwords("english"))


def _types(spark, d, spec=TokenSpec(), table="documents"):
    """(type, n): types of the texts with partial counts."""
    return counted_runs(_T(spark, d, table), 1, spec=spec).select(F.col("run").alias("type"), "n")


def term_census(spark, d):
    return C.census(_types(spark, d), weight="n").select("item", F.col("weight").cast("long").alias("n"))


def term_topk(spark, d):
    return C.census_sorted(C.census(_types(spark, d), weight="n"), 50).select("item", F.col("weight").cast("long").alias("n"))


def doc_token_counts(spark, d):
    t = _T(spark, d, "documents").select("doc_id", types_of(F.col("text")).alias("types"))
    return t.select("doc_id", F.coalesce(F.size("types"), F.lit(0)).cast("long").alias("n_tokens"), F.size(F.array_distinct("types")).cast("long").alias("n_types"))


def drop_classes(spark, d):
    return C.census(_types(spark, d, TokenSpec(drop_classes=("punct", "symbol", "number"))), weight="n").select("item", F.col("weight").cast("long").alias("n"))


def stopword_drop(spark, d):
    return C.census(_types(spark, d, TokenSpec(drop_classes=("punct", "symbol")).without(ENGLISH)), weight="n").select("item", F.col("weight").cast("long").alias("n"))


def drop_exception(spark, d):
    return C.census(_types(spark, d, TokenSpec(drop_classes=("punct",), drop=("the", "of"), drop_except=("of", "."))), weight="n").select("item", F.col("weight").cast("long").alias("n"))


def combine_terms(spark, d):
    types = _types(spark, d, TokenSpec(combine=("of the", "in the", "gnu general public license")))
    return C.census(types.where(F.col("type").contains("_")), weight="n").select("item", F.col("weight").cast("long").alias("n"))


def benchmark_ngrams(spark, d):
    docs = _T(spark, d, "benchmark").select(types_of(F.col("text")).alias("types"))
    return C.ngrams(docs, 3).select(F.concat_ws(" ", "ngram").alias("ngram"), "length", F.col("weight").cast("long").alias("n"))


def document_bigram_count(spark, d):
    docs = _T(spark, d, "documents").select("text")
    return C.text_ngrams(docs, 2).groupBy("length").agg(F.count("*").alias("n_distinct"), F.sum("weight").cast("long").alias("n"))


def vocabulary(spark, d):
    return C.vocabulary(tokens(_T(spark, d, "documents").select("text"), fields=("token", "type", "kind")).where("kind = 'letter'")).select("type", F.concat_ws(" ", "tokens").alias("tokens"))


def vocab_ids(spark, d):
    return C.distinct_ids(first_places(_T(spark, d, "documents"), "doc_id"), "type", ["doc_id", "pos"])


def int_ids(spark, d):
    return C.distinct_ids(_T(spark, d, "events").select("event_id", "user_id"), "user_id", ["event_id"])


def text_search(spark, d):
    docs = _T(spark, d, "documents").select("doc_id", "text")
    return search(docs, terms_frame(spark, ["the", "of the", "mit license", "public license version"])).select("doc_id", "term", "length").groupBy("doc_id", "term", "length").agg(F.count("*").alias("n"))


def _event_arrays(spark, d):
    e = _T(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("pos"), "event_type")
    return C.type_arrays(e, ["user_id"], "pos", "event_type")


def event_census(spark, d):
    e = C.census(_T(spark, d, "events"), "event_type", "value")
    return e.select("item", F.round("weight", 4).alias("weight"))


def event_bigrams(spark, d):
    return C.ngrams(_event_arrays(spark, d), 2).select(F.concat_ws(" ", "ngram").alias("ngram"), "length", F.col("weight").cast("long").alias("n"))


def event_search(spark, d):
    terms = spark.createDataFrame([(0, ["view", "click"]), (1, ["click"]), (2, ["view", "view", "click"])], "term_id int, types array<string>")
    assert terms.count() <= BROADCAST_TERMS
    a = _event_arrays(spark, d).select("user_id", F.transform("types", lambda x, i: F.struct(i.alias("pos"), x.alias("type"))).alias("items"))
    each = a.select("user_id", F.explode(occurrences(F.col("items"), [1, 2, 3])).alias("o")).select("user_id", "o.types", F.col("o.first.pos").cast("long").alias("pos"))
    return each.join(F.broadcast(terms), "types").select("user_id", "term_id", "pos")


def term_membership(spark, d):
    bench = _T(spark, d, "benchmark").select(F.explode(types_of(F.col("text"))).alias("type"))
    return C.census(C.having(_types(spark, d), bench, ["type"], False), weight="n").select("item", F.col("weight").cast("long").alias("n"))


def json_get_k(spark, d):
    return _T(spark, d, "events").select("event_id", ndjson.get_field(F.col("props"), "k").alias("k"))


def json_scan_types(spark, d):
    return ndjson.scan_types(_T(spark, d, "events").select("props"), "props")


def json_decode(spark, d):
    raw = _T(spark, d, "events").select("event_id", ndjson.get_field(F.col("props"), "k").alias("raw"))
    return raw.select("event_id", ndjson.as_int(F.col("raw")).alias("as_int"), ndjson.as_double(F.col("raw")).alias("as_double"))


def json_fields(spark, d):
    e = _T(spark, d, "events").select("event_id", F.posexplode(ndjson.fields_of(F.col("props"))).alias("at", "f"))
    return e.select("event_id", F.col("at").cast("long").alias("at"), "f.name", "f.value")


def prefix_tree(spark, d):
    return C.prefix_tree(_T(spark, d, "benchmark").select(types_of(F.col("text")).alias("types")), "types").groupBy("depth").agg(F.count("*").alias("n_nodes"))


_PLACES = ("start", "size", "kind")


def document_sentences(spark, d):
    return sentences(_T(spark, d, "documents").select("doc_id", "text"), fields=_PLACES).select("doc_id", "pos", "start", "size", "kind")


def sentences_suppressed(spark, d):
    return sentences(_T(spark, d, "conversations").select("conv_id", "turn", "text"), suppress="english", fields=_PLACES).select("conv_id", "turn", "pos", "start", "size", "kind")


def tokens_stemmed(spark, d):
    return C.census(_types(spark, d, TokenSpec(drop_classes=("punct", "symbol"), stem="english").without(ENGLISH)), weight="n").select("item", F.col("weight").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (term_census, term_topk, doc_token_counts, drop_classes, stopword_drop, drop_exception, combine_terms, benchmark_ngrams, document_bigram_count, vocabulary, vocab_ids, int_ids, text_search, event_census, event_bigrams, event_search, term_membership, json_get_k, json_scan_types, json_decode, json_fields, prefix_tree, document_sentences, sentences_suppressed, tokens_stemmed)} | json_queries.QUERIES | text_queries.QUERIES

_WORD = r"(?:_*(?:\p{L}+(?:[.:''·‘’]\p{L}+)*|\p{N}+(?:[.,;'']\p{N}+)*)_*)+"
_PAT = rf"[#@][\p{{L}}\p{{N}}_]+|{_WORD}|[^\s]"
_CUT = r"regexp_replace(text, '([\p{L}\p{N}_])([#@])', '\1 \2 ', 'g')"
_FOLD = "replace(lower(t), 'ß', 'ss')"


def _tok(table: str = "documents", key: str = "doc_id") -> str:
    """CTE ``tok(key, pos, token, type)``: the word rules in one regular expression without look-around."""
    return rf"""raw AS (SELECT {key}, regexp_extract_all({_CUT}, '{_PAT}') AS ts FROM {table}),
tok AS (SELECT {key}, i - 1 AS pos, ts[i] AS token, replace(lower(ts[i]), 'ß', 'ss') AS type FROM raw, unnest(range(1, len(ts) + 1)) AS r(i))"""


_LETTER = r"regexp_matches(type, '^_*\p{L}')"
_NUMBER = r"regexp_matches(type, '^_*\p{N}')"
_SYMBOL = r"regexp_matches(type, '^[\p{S}#%&@]')"
_STOPS = ", ".join("('" + w.replace("'", "''") + "')" for w in ENGLISH)
_COUNT = "SELECT type AS item, count(*) AS n FROM tok"
_EVENTS = "ev AS (SELECT user_id, event_type AS a, lead(event_type) OVER o AS b, lead(event_type, 2) OVER o AS c, row_number() OVER o - 1 AS pos FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))"

SQL = {
    "term_census": f"WITH {_tok()} {_COUNT} GROUP BY type",
    "term_topk": f"WITH {_tok()} {_COUNT} GROUP BY type ORDER BY n DESC, item LIMIT 50",
    "doc_token_counts": f"WITH {_tok()} SELECT doc_id, count(pos) AS n_tokens, count(DISTINCT type) AS n_types FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id",
    "drop_classes": f"WITH {_tok()} {_COUNT} WHERE {_LETTER} GROUP BY type",
    "stopword_drop": f"WITH stops(w) AS (VALUES {_STOPS}), {_tok()} {_COUNT} WHERE ({_LETTER} OR {_NUMBER}) AND type NOT IN (SELECT w FROM stops) GROUP BY type",
    "drop_exception": f"WITH {_tok()} {_COUNT} WHERE type <> 'the' AND ({_LETTER} OR {_NUMBER} OR {_SYMBOL} OR type = '.') GROUP BY type",
    "benchmark_ngrams": f"""WITH {_tok("benchmark", "item_id")}, w AS (SELECT type AS a, lead(type) OVER o AS b, lead(type, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY item_id ORDER BY pos)),
g AS (SELECT a AS ngram, 1 AS length FROM w UNION ALL SELECT a || ' ' || b, 2 FROM w WHERE b IS NOT NULL UNION ALL SELECT a || ' ' || b || ' ' || c, 3 FROM w WHERE c IS NOT NULL)
SELECT ngram, length::INT AS length, count(*) AS n FROM g GROUP BY ALL""",
    "document_bigram_count": f"""WITH {_tok()}, w AS (SELECT type AS a, lead(type) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok),
g AS (SELECT a, NULL AS b, 1 AS length FROM w UNION ALL SELECT a, b, 2 FROM w WHERE b IS NOT NULL), c AS (SELECT length, a, b, count(*) AS n FROM g GROUP BY ALL)
SELECT length::INT AS length, count(*) AS n_distinct, sum(n)::BIGINT AS n FROM c GROUP BY length""",
    "vocabulary": f"WITH {_tok()} SELECT type, array_to_string(list_sort(list(DISTINCT token)), ' ') AS tokens FROM tok WHERE {_LETTER} GROUP BY type",
    "vocab_ids": f"WITH {_tok()}, f AS (SELECT type AS item, min((doc_id, pos)) AS first FROM tok GROUP BY type) SELECT item, row_number() OVER (ORDER BY first) - 1 AS id FROM f",
    "int_ids": "WITH f AS (SELECT user_id AS item, min(event_id) AS first FROM events GROUP BY user_id) SELECT item, row_number() OVER (ORDER BY first) - 1 AS id FROM f",
    "text_search": f"""WITH {_tok()}, w AS (SELECT doc_id, type AS a, lead(type) OVER o AS b, lead(type, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT doc_id, 'the' AS term, 1 AS length FROM w WHERE a = 'the' UNION ALL SELECT doc_id, 'of the', 2 FROM w WHERE a = 'of' AND b = 'the'
UNION ALL SELECT doc_id, 'mit license', 2 FROM w WHERE a = 'mit' AND b = 'license' UNION ALL SELECT doc_id, 'public license version', 3 FROM w WHERE a = 'public' AND b = 'license' AND c = 'version')
SELECT doc_id, term, length::INT AS length, count(*) AS n FROM m GROUP BY ALL""",
    "event_census": "SELECT event_type AS item, round(sum(value), 4) AS weight FROM events GROUP BY event_type",
    "event_bigrams": f"WITH {_EVENTS}, g AS (SELECT a AS ngram, 1 AS length FROM ev UNION ALL SELECT a || ' ' || b, 2 FROM ev WHERE b IS NOT NULL) SELECT ngram, length::INT AS length, count(*) AS n FROM g GROUP BY ALL",
    "event_search": f"WITH {_EVENTS} SELECT user_id, 0::INT AS term_id, pos FROM ev WHERE a = 'view' AND b = 'click' UNION ALL SELECT user_id, 1::INT, pos FROM ev WHERE a = 'click' UNION ALL SELECT user_id, 2::INT, pos FROM ev WHERE a = 'view' AND b = 'view' AND c = 'click'",
    "term_membership": f"WITH {_tok()}, {_tok('benchmark', 'item_id').replace('raw AS', 'raw2 AS').replace('FROM raw,', 'FROM raw2,').replace('tok AS', 'tok2 AS')} {_COUNT} WHERE type NOT IN (SELECT type FROM tok2) GROUP BY type",
    "json_get_k": "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k FROM events",
    "json_scan_types": """SELECT '{ "k": ' || CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'real' WHEN 'VARCHAR' THEN 'text' ELSE 'any' END || ' }' AS type, count(*) AS n FROM events GROUP BY 1""",
    "json_decode": "SELECT event_id, json_extract_string(props, '$.k')::INT AS as_int, json_extract_string(props, '$.k')::DOUBLE AS as_double FROM events",
    "json_fields": "SELECT event_id, (i - 1)::BIGINT AS at, json_keys(props)[i] AS name, json_extract(props, '$.' || json_keys(props)[i])::VARCHAR AS value FROM events, unnest(range(1, len(json_keys(props)) + 1)) AS r(i)",
    "prefix_tree": f"WITH {_tok('benchmark', 'item_id')}, p AS (SELECT DISTINCT pos + 1 AS depth, string_agg(type, ' ') OVER (PARTITION BY item_id ORDER BY pos) AS path FROM tok) SELECT depth::INT AS depth, count(*) AS n_nodes FROM p GROUP BY depth",
}
_SENTENCE = "pos::INT AS pos, start::INT AS start, size::INT AS size, kind FROM sentence"
SQL |= {
    "document_sentences": f"WITH {sentence_sql.sentences()} SELECT doc_id, {_SENTENCE}",
    "sentences_suppressed": f"WITH {sentence_sql.sentences('conversations', 'conv_id, turn', suppressions('english'))} SELECT conv_id, turn, {_SENTENCE}",
    "tokens_stemmed": f"WITH stops(w) AS (VALUES {_STOPS}), {_tok()}, words AS (SELECT type AS word FROM tok WHERE {_LETTER} AND type NOT IN (SELECT w FROM stops)), {stem_sql.english('words')}, kept AS (SELECT CASE WHEN {_LETTER} THEN stem ELSE type END AS item FROM tok LEFT JOIN stemmed ON word = type WHERE ({_LETTER} OR {_NUMBER}) AND type NOT IN (SELECT w FROM stops)) SELECT item, count(*) AS n FROM kept WHERE item NOT IN (SELECT w FROM stops) GROUP BY item",
    **json_queries.sql(_tok),
    **text_queries.sql(_tok, _WORD),
}
