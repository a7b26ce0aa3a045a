"""Registered queries on tokens, spans, normalisation, stems, stop words and trees, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import TokenSpec
from ..operators import counts as C
from ..operators.search import search, terms_frame
from ..operators.text import break_classes_of, counted_runs, sentences, spread, tokens, types_of, width_of
from ..resources import stopword_names, stopwords
from . import sentence_sql

GLUED = ("the.", "of.", "et.", "der.", "de.", "und.", "Y.", "in.")
TERMS = ("the", "of the", "mit license", "public license version")


def _docs(spark, d, table="documents", *columns):
    return spread(spark.read.parquet(f"{d}/{table}.parquet").select(*(columns or ("doc_id", "text"))))


def token_spans(spark, d):
    t = tokens(_docs(spark, d), fields=("start", "size"))
    total = lambda c: F.sum(c.cast("long"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), total(F.col("start")).alias("starts"), total(F.col("size")).alias("sizes"), total(F.col("pos").cast("long") * F.col("start")).alias("places"))


def token_kinds(spark, d):
    return tokens(_docs(spark, d), fields=("kind",)).groupBy("kind").agg(F.count("*").alias("n"))


def word_break_classes(spark, d):
    each = _docs(spark, d).select(F.inline(break_classes_of(F.col("text"))))
    return each.groupBy("property").agg(F.sum("n").alias("n"))


def text_widths(spark, d):
    return _docs(spark, d).select("doc_id", width_of(F.col("text")).alias("width"))


def normalized_types(spark, d):
    """Compatibility forms, ignorables, decomposed letters and quotes put into the texts and folded away again."""
    t = F.col("text")
    for a, b in (("i", "\ufb01"), ("n", "n\u00ad"), ("\u00e9", "e\u0301"), ('"', "\u2019")):
        t = F.replace(t, F.lit(a), F.lit(b))
    types = counted_runs(_docs(spark, d).select(t.alias("text")), 1)
    return C.census(types, "run", "n").select("item", F.col("weight").cast("long").alias("n"))


def first_four(word: str) -> str:
    """A user's stemmer."""
    return word[:4]


def user_stems(spark, d):
    types = counted_runs(_docs(spark, d), 1, spec=TokenSpec(stem=first_four, stem_except=("where", "therefore", "eines")))
    return C.census(types, "run", "n").select("item", F.col("weight").cast("long").alias("n"))


def combined_spans(spark, d):
    """Combined words with another connector, where they stand."""
    t = tokens(_docs(spark, d), spec=TokenSpec(combine=("of the", "in the", "gnu general public license"), connector="+"), fields=("start", "size", "type")).where(F.col("type").contains("+") & (F.length("type") > 1))
    return t.select("doc_id", "start", "size", "type")


def text_search_spans(spark, d):
    return search(_docs(spark, d), terms_frame(spark, list(TERMS))).select("doc_id", "term", "start", "size", "end_pos", "length")


def text_search_bridged(spark, d):
    """A match spans the words that the filter drops."""
    spec = TokenSpec(drop_classes=("punct", "symbol"), drop=("of",))
    return search(_docs(spark, d), terms_frame(spark, ["the the", "and the", "license version"], spec), spec=spec).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("sizes"))


def stopword_counts(spark, d):
    """Tokens of each document that are stop words, by list."""
    lists = spark.createDataFrame([(n, w) for n in stopword_names() for w in stopwords(n)], "language string, type string")
    types = _docs(spark, d).select("doc_id", F.explode(types_of(F.col("text"))).alias("type"))
    return types.join(F.broadcast(lists), "type").groupBy("language").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def sequence_ids(spark, d):
    roles = C.type_arrays(spark.read.parquet(f"{d}/conversations.parquet"), ["conv_id"], "turn", "role")
    return C.distinct_ids(roles, "types", ["conv_id"]).select(F.concat_ws(" ", "item").alias("item"), "id")


def int_set_sorted(spark, d):
    ids = C.distinct_ids(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id"), "user_id", ["event_id"])
    return C.sorted_ids(ids)


def numbered_tree(spark, d):
    heads = _docs(spark, d, "benchmark", "item_id", "text").select(F.slice(types_of(F.col("text")), 1, 4).alias("types"))
    return C.numbered_tree(C.prefix_tree(heads, "types")).select("id", "parent_id", F.col("depth").cast("int").alias("depth"), "item")


def stem_samples(spark, d):
    """Words and stems of the published sample vocabularies."""
    words = spark.createDataFrame([(a, w) for a, pairs in SAMPLES.items() for w in pairs], "algorithm string, word string")
    parts = [words.where(F.col("algorithm") == a).select("algorithm", "word", F.get(types_of(F.col("word"), TokenSpec(stem=a)), F.lit(0)).alias("stem")) for a in sorted(SAMPLES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pairs(text: str) -> dict[str, str]:
    return dict(p.split(":") for p in text.split())


SAMPLES = {
    "english": _pairs("consign:consign consigned:consign consigning:consign consignment:consign consolation:consol consolatory:consolatori knackeries:knackeri knightly:knight knots:knot"),
    "porter": _pairs("consigned:consign consolation:consol knavish:knavish knocked:knock"),
    "german": _pairs("aufeinander:aufeinand kategorien:kategori kategorischen:kategor jahrhunderts:jahrhundert aufgefressen:aufgefress"),
    "french": _pairs("continuellement:continuel continuelle:continuel continuité:continu majestueusement:majestu jouissait:jou"),
    "spanish": _pairs("chicharrones:chicharron torneado:torn chicas:chic toreros:torer"),
    "italian": _pairs("abbandonata:abbandon pronunciamento:pronunc propendere:propend"),
    "portuguese": _pairs("boataria:boat quilométricas:quilométr quilos:quil boato:boat"),
    "russian": _pairs("важного:важн важнейшими:важн паданье:падан пальмирский:пальмирск"),
    "dutch": _pairs("lichaamsziek:lichaamsziek lichamelijkheden:licham opglimpende:opglimp opglimlachten:opglimlacht"),
    "swedish": _pairs("jaktkarlarne:jaktkarl klostret:klostret klosterliga:kloster jollrandes:jollr"),
    "danish": _pairs("undersøgelser:undersøg indvendinger:indvending"),
    "norwegian": _pairs("havnedistriktene:havnedistrikt opnings:opning"),
    "finnish": _pairs("edeltäjistään:edeltäj innostuneena:innostun"),
    "hungarian": _pairs("babakocsiját:babakocs babakocsi:babakocs"),
    "romanian": _pairs("abruptă:abrupt abruptele:abrupt absentă:absent absolutele:absol"),
}


def sentences_glued(spark, d):
    found = sentences(_docs(spark, d), suppress=GLUED, fields=("start", "size", "kind"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"), "kind")


QUERIES = {f.__name__: f for f in (token_spans, token_kinds, text_widths, word_break_classes, normalized_types, user_stems, combined_spans, text_search_spans, text_search_bridged, stopword_counts, sequence_ids, int_set_sorted, numbered_tree, stem_samples, sentences_glued)}


def spans(pattern: str, table: str = "documents", key: str = "doc_id") -> str:
    """CTE ``span(key, pos, start, size, type)``: as the token CTE, with offsets; pieces of white space are counted and left out."""
    cut = rf"regexp_replace(text, '([\p{{L}}\p{{N}}_])([#@])', '\1' || chr(1) || '\2' || chr(1), 'g')"
    return rf"""sraw AS (SELECT {key}, regexp_extract_all({cut}, '{pattern}|\s+') AS ts FROM {table}),
spiece AS (SELECT {key}, i, ts[i] AS t FROM sraw, unnest(range(1, len(ts) + 1)) AS r(i)),
splace AS (SELECT {key}, i, t, length(t) AS size, sum(length(t)) OVER (PARTITION BY {key} ORDER BY i) - length(t) AS start FROM spiece),
span AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos, i, start, size, replace(lower(t), 'ß', 'ss') AS type FROM splace WHERE NOT regexp_matches(t, '^\s'))"""


def sql(tok, word: str) -> dict[str, str]:
    """SQL by query; ``tok`` gives the token CTE, ``word`` is the pattern of a word."""
    pat = rf"[#@][\p{{L}}\p{{N}}_]+|{word}|[^\s\x01]"
    span = spans(pat)
    letter, number, symbol = (rf"regexp_matches(type, '{x}')" for x in (r"^_*\p{L}", r"^_*\p{N}", r"^[\p{S}#%&@]"))
    stops = ", ".join("('{}', '{}')".format(n, w.replace("'", "''")) for n in stopword_names() for w in stopwords(n))
    glue = lambda *words: " UNION ALL ".join("SELECT doc_id, start, e{n} - start AS size, '{t}' AS type FROM w WHERE {c} AND gaps{n}".format(n=len(p), t="+".join(p), c=" AND ".join(f"t{k} = '{x}'" for k, x in enumerate(p, 1))) for p in words)
    phrases = f"""{span}, w AS (SELECT doc_id, start, type AS t1, lead(type, 1) OVER o AS t2, lead(type, 2) OVER o AS t3, lead(type, 3) OVER o AS t4, lead(start + size, 1) OVER o AS e2, lead(start + size, 3) OVER o AS e4,
  lead(i, 1) OVER o = i + 2 AS gaps2, lead(i, 1) OVER o = i + 2 AND lead(i, 2) OVER o = i + 4 AND lead(i, 3) OVER o = i + 6 AS gaps4 FROM span WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
phrase AS ({glue(("of", "the"), ("in", "the"), ("gnu", "general", "public", "license"))})"""
    return {
        "token_spans": f"WITH {span} SELECT doc_id, count(*) AS n, sum(start)::BIGINT AS starts, sum(size)::BIGINT AS sizes, sum(pos * start)::BIGINT AS places FROM span GROUP BY doc_id",
        "token_kinds": f"WITH {tok()} SELECT CASE WHEN {letter} THEN 'letter' WHEN {number} THEN 'number' WHEN {symbol} THEN 'symbol' ELSE 'punct' END AS kind, count(*) AS n FROM tok GROUP BY 1",
        "text_widths": "SELECT doc_id, length(replace(text, chr(10), ''))::BIGINT AS width FROM documents",
        "word_break_classes": r"""WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents) SELECT CASE WHEN regexp_matches(c, '\p{L}') THEN 'aletter' WHEN c BETWEEN '0' AND '9' THEN 'numeric' WHEN c = ' ' THEN 'white_space' WHEN c = chr(10) THEN 'lf' WHEN c = '.' THEN 'midnumlet'
WHEN c IN (',', ';') THEN 'midnum' WHEN c = ':' THEN 'midletter' WHEN c = '"' THEN 'double_quote' WHEN c = '-' THEN 'hyphen' WHEN c = chr(39) THEN 'single_quote' WHEN c = '_' THEN 'extendnumlet' WHEN c IN ('!', '?', '(', ')', '*', '/', '[', ']', '{', '}') THEN 'punctuation' ELSE 'symbol' END AS property, count(*) AS n FROM c GROUP BY 1""",
        "normalized_types": f"WITH {tok()} SELECT CASE WHEN type = '\"' THEN '''' ELSE replace(lower(replace(token, 'i', 'fi')), 'ß', 'ss') END AS item, count(*) AS n FROM tok GROUP BY 1",
        "user_stems": f"WITH {tok()} SELECT CASE WHEN {letter} AND type NOT IN ('where', 'therefore', 'eines') THEN left(type, 4) ELSE type END AS item, count(*) AS n FROM tok GROUP BY 1",
        "combined_spans": f"WITH {phrases} SELECT doc_id, start::INT AS start, size::INT AS size, type FROM phrase",
        "combine_terms": f"WITH {phrases} SELECT replace(type, '+', '_') AS item, count(*) AS n FROM phrase GROUP BY 1",
        "text_search_spans": f"""WITH {span}, w AS (SELECT doc_id, start, start + size AS e1, type AS t1, lead(type, 1) OVER o AS t2, lead(type, 2) OVER o AS t3, lead(start + size, 1) OVER o AS e2, lead(start + size, 2) OVER o AS e3 FROM span WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT doc_id, 'the' AS term, start, e1 AS stop, 1 AS length FROM w WHERE t1 = 'the' UNION ALL SELECT doc_id, 'of the', start, e2, 2 FROM w WHERE t1 = 'of' AND t2 = 'the' UNION ALL SELECT doc_id, 'mit license', start, e2, 2 FROM w WHERE t1 = 'mit' AND t2 = 'license'
UNION ALL SELECT doc_id, 'public license version', start, e3, 3 FROM w WHERE t1 = 'public' AND t2 = 'license' AND t3 = 'version')
SELECT doc_id, term, start::INT AS start, (stop - start)::INT AS size, stop::INT AS end_pos, length::INT AS length FROM m""",
        "text_search_bridged": f"""WITH {span}, k AS (SELECT * FROM span WHERE ({letter} OR {number}) AND type <> 'of'),
w AS (SELECT doc_id, start, type AS a, lead(type) OVER o AS b, lead(start + size) OVER o - start AS size FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, a || ' ' || b AS term, count(*) AS n, sum(size)::BIGINT AS sizes FROM w WHERE a || ' ' || b IN ('the the', 'and the', 'license version') GROUP BY ALL""",
        "stopword_counts": f"WITH stops(language, type) AS (VALUES {stops}), {tok()} SELECT language, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok JOIN stops USING (type) GROUP BY language",
        "sequence_ids": "WITH a AS (SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS item FROM conversations GROUP BY conv_id), f AS (SELECT item, min(conv_id) AS first FROM a GROUP BY item) SELECT item, row_number() OVER (ORDER BY first) - 1 AS id FROM f",
        "int_set_sorted": "WITH f AS (SELECT user_id AS item, min(event_id) AS first FROM events GROUP BY user_id) SELECT item, row_number() OVER (ORDER BY first) - 1 AS id, row_number() OVER (ORDER BY item) - 1 AS rank FROM f",
        "numbered_tree": f"""WITH {tok("benchmark", "item_id")}, h AS (SELECT item_id, list(type ORDER BY pos) AS ts FROM tok WHERE pos < 4 GROUP BY item_id), p AS (SELECT DISTINCT ts[1:k] AS path FROM h, unnest(range(1, len(ts) + 1)) AS r(k)),
n AS (SELECT path, row_number() OVER (ORDER BY len(path), path) - 1 AS id FROM p) SELECT n.id, m.id AS parent_id, len(n.path)::INT AS depth, n.path[-1] AS item FROM n LEFT JOIN n AS m ON m.path = n.path[1:len(n.path) - 1] AND len(n.path) > 1""",
        "stem_samples": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{w}', '{s}')" for a, pairs in SAMPLES.items() for w, s in pairs.items()) + ") AS t(algorithm, word, stem)",
        "sentences_glued": f"WITH {sentence_sql.sentences(abbreviations=list(GLUED))} SELECT doc_id, pos, start::BIGINT AS start, size::BIGINT AS size, kind FROM sentence",
    }
