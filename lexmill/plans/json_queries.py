"""Registered queries over JSON lines, which are put together from the tables' columns, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.text import source_sentences, types_of
from ..sources import ndjson
from ..sources.saved import shared_folder
from . import sentence_sql

#: Lines of eight shapes by event; the same expression in both dialects.
MIXED = """CASE event_id % 8 WHEN 0 THEN concat(' ', event_id) WHEN 1 THEN concat(event_id, '.5') WHEN 2 THEN concat('"', event_type, '"')
WHEN 3 THEN concat('[', user_id, ', ', event_id, '.25]') WHEN 4 THEN concat('{"k": ', event_id, ', "t": "', event_type, '"}')
WHEN 5 THEN concat('{"k": ', event_id, '.5, "a": [true, null]}') WHEN 6 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE ' false ' END ELSE 'null' END"""
_ITEMS = """concat('[', event_id, ', "', event_type, '", [1, ', user_id, '], {"k": [', value, ', "]"]}, null ]')"""
_RECORD = """concat('{"z": ', event_id, ', "a" : "', event_type, '", "m": [', user_id, ', 1.0], "b": null}')"""


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _mixed(spark, d):
    return _events(spark, d).select("event_id", F.expr(MIXED).alias("line"))


def json_mixed_types(spark, d):
    return ndjson.scan_types(_mixed(spark, d), "line")


def json_unions(spark, d):
    """One row for the records alone and one for all lines; types are folded in the tasks first."""
    lines = _mixed(spark, d)
    rows = []
    for what, some in (("records", lines.where("event_id % 8 IN (4, 5)")), ("arrays and null", lines.where("event_id % 8 IN (3, 7)")), ("numbers", lines.where("event_id % 8 IN (0, 1)")), ("all", lines)):
        t, n = ndjson.scan_schema(some, "line")
        rows.append((what, t.render(), n))
    return spark.createDataFrame(rows, "lines string, type string, n long")


def json_array_items(spark, d):
    e = _events(spark, d).select("event_id", F.posexplode(ndjson.items_of(F.expr(_ITEMS))).alias("at", "value"))
    return e.select("event_id", F.col("at").cast("long").alias("at"), "value")


def json_array_lengths(spark, d):
    return _mixed(spark, d).select("event_id", ndjson.n_items(F.col("line")).cast("long").alias("n_items"))


def json_booleans(spark, d):
    return _mixed(spark, d).select("event_id", ndjson.as_bool(F.col("line")).alias("as_bool"))


def json_numbers(spark, d):
    return _mixed(spark, d).select("event_id", ndjson.as_int(F.concat("line", F.lit("0000000"))).alias("as_int"), ndjson.as_double(F.col("line")).alias("as_double"))


def json_texts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    raw = ndjson.get_field(F.to_json(F.struct("doc_id", "text")), "text")
    return docs.select("doc_id", F.sha2(ndjson.as_text(raw), 256).alias("sha256"))


def json_field_counts(spark, d):
    return _mixed(spark, d).select("event_id", ndjson.n_fields(F.col("line")).cast("long").alias("n_fields"))


def json_record_order(spark, d):
    e = _events(spark, d).select("event_id", F.posexplode(ndjson.fields_of(F.expr(_RECORD))).alias("at", "f"))
    return e.select("event_id", F.col("at").cast("long").alias("at"), "f.name", "f.value")


def _talk(spark, d):
    """Lines that are bare strings, records with a text and records without."""
    line = F.to_json(F.struct("role", "text"))
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    return c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, ndjson.get_field(line, "text")).when(F.col("turn") % 3 == 1, line).otherwise(F.to_json(F.struct("role"))).alias("line"))


def text_or_field(spark, d):
    return _talk(spark, d).select("conv_id", "turn", ndjson.text_of(F.col("line")).alias("text"))


def tokens_output(spark, d):
    types = types_of(ndjson.text_of(F.col("line")))
    return _talk(spark, d).select("conv_id", "turn", ndjson.text_array(types).alias("line"))


def sentences_output(spark, d):
    return _talk(spark, d).select("conv_id", "turn", source_sentences(ndjson.raw_text(F.col("line"))).alias("line"))


def ndjson_roundtrip(spark, d):
    """Lines written to the shared folder and read again."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    ndjson.write_lines(spark.read.parquet(f"{d}/benchmark.parquet").select(F.to_json(F.struct("item_id", "text"))), path)
    line = F.col("value")
    return ndjson.read_lines(spark, path).select(ndjson.as_int(ndjson.get_field(line, "item_id")).cast("long").alias("item_id"), ndjson.text_of(line).alias("text"))


QUERIES = {f.__name__: f for f in (json_mixed_types, json_unions, json_array_items, json_array_lengths, json_booleans, json_numbers, json_texts, json_field_counts, json_record_order, text_or_field, tokens_output, sentences_output, ndjson_roundtrip)}

_QUOTED = r"""'"' || array_to_string(list_transform(string_split(x, ''), lambda c: CASE WHEN c IN ('"', '\') THEN '\' || c WHEN unicode(c) > 126 THEN '\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE c END), '') || '"'"""


def sql(tok) -> dict[str, str]:
    """SQL by query; ``tok(table, key)`` gives the token CTE."""
    talk = "CASE WHEN turn % 3 < 2 THEN text END"
    spoken = f"(SELECT conv_id, turn, {talk} AS text FROM conversations WHERE text IS NOT NULL)"
    return {
        "json_mixed_types": """SELECT CASE event_id % 8 WHEN 0 THEN 'integer' WHEN 1 THEN 'real' WHEN 2 THEN 'text' WHEN 3 THEN '[real; 2]' WHEN 4 THEN '{ "k": integer, "t": text }' WHEN 5 THEN '{ "a": [boolean; 2], "k": real }' WHEN 6 THEN 'boolean' ELSE 'null' END AS type, count(*) AS n FROM events GROUP BY 1""",
        "json_unions": """SELECT 'records' AS lines, '{ "a": [boolean; 2], "k": real, "t": text }' AS type, count(*) AS n FROM events WHERE event_id % 8 IN (4, 5)
UNION ALL SELECT 'arrays and null', '[real; 2]', count(*) FROM events WHERE event_id % 8 IN (3, 7) UNION ALL SELECT 'numbers', 'real', count(*) FROM events WHERE event_id % 8 IN (0, 1) UNION ALL SELECT 'all', 'any', count(*) FROM events""",
        "json_array_items": """SELECT event_id, i - 1 AS at, ([event_id::VARCHAR, '"' || event_type || '"', '[1, ' || user_id || ']', '{"k": [' || value || ', "]"]}', 'null'])[i] AS value FROM events, unnest(range(1, 6)) AS r(i)""",
        "json_array_lengths": "SELECT event_id, CASE WHEN event_id % 8 = 3 THEN 2 END::BIGINT AS n_items FROM events",
        "json_booleans": "SELECT event_id, CASE WHEN event_id % 8 = 6 THEN user_id % 2 = 0 END AS as_bool FROM events",
        "json_numbers": "SELECT event_id, CASE WHEN event_id % 8 = 0 THEN least(event_id * 10000000, 2147483647) END::INT AS as_int, CASE event_id % 8 WHEN 0 THEN event_id WHEN 1 THEN event_id + 0.5 END::DOUBLE AS as_double FROM events",
        "json_texts": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
        "json_field_counts": "SELECT event_id, CASE WHEN event_id % 8 IN (4, 5) THEN 2 END::BIGINT AS n_fields FROM events",
        "json_record_order": """SELECT event_id, i - 1 AS at, (['z', 'a', 'm', 'b'])[i] AS name, ([event_id::VARCHAR, '"' || event_type || '"', '[' || user_id || ', 1.0]', 'null'])[i] AS value FROM events, unnest(range(1, 5)) AS r(i)""",
        "text_or_field": f"SELECT conv_id, turn, {talk} AS text FROM conversations WHERE text IS NOT NULL",
        "tokens_output": f"""WITH {tok(spoken, "conv_id, turn")}, q AS (SELECT conv_id, turn, pos, {_QUOTED} AS q FROM (SELECT conv_id, turn, pos, type AS x FROM tok)),
a AS (SELECT conv_id, turn, '[' || string_agg(q, ', ' ORDER BY pos) || ']' AS line FROM q GROUP BY conv_id, turn)
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'null' ELSE coalesce(line, '[]') END AS line FROM conversations LEFT JOIN a USING (conv_id, turn) WHERE text IS NOT NULL""",
        "sentences_output": rf"""WITH {sentence_sql.sentences(spoken, "conv_id, turn")}, a AS (SELECT conv_id, turn, '[' || string_agg('"' || replace(replace(replace(sentence, '\', '\\'), '"', '\"'), chr(10), '\n') || '"', ', ' ORDER BY pos) || ']' AS line FROM sentence GROUP BY conv_id, turn)
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'null' ELSE line END AS line FROM conversations LEFT JOIN a USING (conv_id, turn) WHERE text IS NOT NULL""",
        "ndjson_roundtrip": "SELECT item_id, text FROM benchmark",
    }
