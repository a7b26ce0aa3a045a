"""The subpackage's queries and their SQL, for the top-level registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .fingerprint import edited_fingerprints
from .language_id import fit, held_out, identify
from .license_scan import K, license_scan, template_rows
from .lm_score import lm_score
from .mixing import TARGETS, label_domain, mix
from .near_dup import near_dup
from .pii import find, rendered
from .substring_dedup import substring_dedup

from .token_counts import token_counts


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup(_t(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark, sf_dir):
    return license_scan(_t(spark, sf_dir, "documents")).drop("spans")


def op3_fingerprints(spark, sf_dir):
    return edited_fingerprints(_t(spark, sf_dir, "documents")).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.col("first_edit.section").alias("edit_section"), F.col("first_edit.paragraph").alias("edit_paragraph"))


def op4_near_dup(spark, sf_dir):
    return near_dup(_t(spark, sf_dir, "documents"), shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_lm_scoring(spark, sf_dir):
    return lm_score(_t(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op6_token_counts(spark, sf_dir):
    return token_counts(_t(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op7_pii(spark, sf_dir):
    found = find(_t(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("d.doc_id", *(count(k).alias(f"n_{n}") for k, n in enumerate(("email", "ip", "card", "phone"))), F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def op8_language_id(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()), "text", "lang", "doc_id")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_mixing(spark, sf_dir):
    found = mix(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), label_domain(), TARGETS)
    return found.select("doc_id", "n_tokens", F.transform("p", lambda x: F.round(x, 6)).alias("posterior"), F.round("rate", 6).alias("rate"))


def op10_decontamination(spark, sf_dir):
    found = decontaminate(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_items", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"), "agree", "contaminated")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_fingerprints, op4_near_dup, op5_lm_scoring, op6_token_counts, op7_pii, op8_language_id, op9_mixing, op10_decontamination)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    known = ", ".join(f"({tid}, '{label}', {base}, {grams}, {t}, '{gram}')" for tid, label, base, grams, t, gram in template_rows())
    return f"""
WITH known(tid, label, base, grams, t, gram) AS (VALUES {known}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + {K - 1}], ' ') AS gram FROM d, unnest(range(1, len(w) - {K - 2})) AS r(i)),
votes AS (SELECT doc_id, tid, label, base, grams, pos - t AS diagonal, list({{'t': t, 'pos': pos}}) AS ts FROM g JOIN known USING (gram) GROUP BY ALL),
steps AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) > 3, true) THEN 1 ELSE 0 END AS new FROM votes),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM steps),
spanned AS (SELECT doc_id, tid, label, base, grams, span, list_reduce(list_sort(flatten(list(ts))), lambda s, x: CASE WHEN s.t >= 0 AND (x.t <= s.t OR x.pos <= s.pos) THEN s ELSE {{'t': x.t, 'pos': x.pos, 'first': coalesce(s.first, x.pos), 'n': s.n + 1}} END, {{'t': -1, 'pos': -1, 'first': NULL, 'n': 0}}) AS run FROM (SELECT doc_id, tid, label, base, grams, span, list_transform(ts, lambda x: {{'t': x.t, 'pos': x.pos, 'first': NULL::BIGINT, 'n': 0}}) AS ts FROM numbered) GROUP BY ALL),
spans AS (SELECT *, run.n / grams AS share, run.first AS start, run.pos + {K} AS stop FROM spanned),
good AS (SELECT * FROM spans WHERE CASE WHEN base THEN share = 1 ELSE share >= 0.6 AND stop - start <= 1.5 * (grams + {K} - 1) END),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, round(max(share), 6) AS score FROM good GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN found USING (doc_id)"""


def _fingerprint_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nxt FROM documents WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, length(text) AS n, text, nxt, left(text, length(text) - length(text) // 3) || left(nxt, length(text) // 3) AS edited FROM d),
x AS (SELECT doc_id, n, sha256(edited) AS edited_sha256, unnest([struct_pack(k := 't', v := text), struct_pack(k := 'e', v := edited), struct_pack(k := 'n', v := nxt)]) AS s FROM e),
y AS (SELECT doc_id, n, edited_sha256, s.k AS k, list_transform(string_split(s.v, E'\n\n'), lambda a: list_transform(string_split(a, E'\n'), lambda p: list_transform(flatten(list_transform(string_split(regexp_replace(p, '([.;:!?] )', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_extract_all(x, '(?s).{1,192}'))), lambda q: md5(q)))) AS t FROM x),
y1 AS (SELECT *, list_transform(t, lambda a: list_transform(a, lambda p: struct_pack(h := md5(coalesce(array_to_string(p, ''), '')), r := coalesce(array_to_string(list_transform(p, lambda q: left(q, 8)), ''), '')))) AS ps FROM y),
y2 AS (SELECT *, list_transform(ps, lambda a: md5(array_to_string(list_transform(a, lambda p: p.h), ''))) AS sh FROM y1),
z AS (SELECT doc_id, n, edited_sha256, k, sha256(array_to_string(sh, '')) AS root, list_transform(ps, lambda a: list_transform(a, lambda p: p.h)) AS ph, sh,
  array_to_string(list_transform(ps, lambda a, i: left(sh[i], 16) || ':' || array_to_string(list_transform(a, lambda p: left(p.h, 16) || '.' || p.r), ',')), ';') AS body, list_distinct(list_transform(flatten(flatten(t)), lambda q: left(q, 8))) AS leaves FROM y2),
p AS (SELECT doc_id, any_value(n) AS n, any_value(edited_sha256) AS edited_sha256, any_value(root) FILTER (k = 't') AS rt, any_value(root) FILTER (k = 'e') AS re, any_value(root) FILTER (k = 'n') AS rn,
  any_value(body) FILTER (k = 't') AS bt, any_value(body) FILTER (k = 'e') AS be, any_value(leaves) FILTER (k = 't') AS lt, any_value(leaves) FILTER (k = 'e') AS le, any_value(leaves) FILTER (k = 'n') AS ln,
  any_value(sh) FILTER (k = 't') AS st, any_value(sh) FILTER (k = 'e') AS se, any_value(ph) FILTER (k = 't') AS pt, any_value(ph) FILTER (k = 'e') AS pe FROM z GROUP BY doc_id),
f AS (SELECT *, coalesce(list_filter(range(1, least(len(st), len(se)) + 1), lambda i: st[i] <> se[i])[1], least(len(st), len(se)) + 1) AS s FROM p),
g AS (SELECT *, coalesce(pt[s], ['']) AS x, coalesce(pe[s], ['']) AS y FROM f)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, rt || '/' || bt AS fingerprint, re || '/' || be AS edited_fingerprint,
  (CASE WHEN rt = re THEN 1 WHEN len(lt) + len(le) = 0 THEN 0 ELSE round(2 * len(list_intersect(lt, le)) / (len(lt) + len(le)), 6) END)::DOUBLE AS near_edited,
  (CASE WHEN rt = rn THEN 1 WHEN len(lt) + len(ln) = 0 THEN 0 ELSE round(2 * len(list_intersect(lt, ln)) / (len(lt) + len(ln)), 6) END)::DOUBLE AS near_next,
  CASE WHEN rt <> re THEN (s - 1)::BIGINT END AS edit_section,
  CASE WHEN rt <> re THEN (coalesce(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i])[1], least(len(x), len(y)) + 1) - 1)::BIGINT END AS edit_paragraph FROM g"""


def _decontamination_sql() -> str:
    """By runs instead of masks: e substitutions in m words leave floor(m / (e + 1)) words in a row untouched."""
    run = lambda g: "||' '||".join(f"w[i + {j}]" for j in range(g))
    runs = lambda src, key: " UNION ALL ".join(f"SELECT {key}, {g} AS g, i AS pos, {run(g)} AS run FROM {src}, unnest(range(1, len(w) - {g} + 2)) AS r(i) WHERE len(w) >= {g}{f' AND g = {g}' if src == 'b' else ''}" for g in (1, 2, 3, 4))
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT *, CASE WHEN size < 5 THEN size WHEN size < 10 THEN size // 2 ELSE size // 3 END AS g FROM (SELECT item_id, w, least(len(w), 13) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0)),
ds AS ({runs("d", "doc_id")}), bs AS ({runs("b", "item_id")}),
a AS (SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS start FROM ds JOIN bs USING (g, run)),
s AS (SELECT doc_id, item_id, start, size, list_transform(range(1, len(b.w) + 1), lambda i: CASE WHEN start + i >= 1 AND start + i <= len(d.w) AND d.w[greatest(start + i, 1)] = b.w[i] THEN 1 ELSE 0 END) AS same FROM a JOIN d USING (doc_id) JOIN b USING (item_id)),
v AS (SELECT doc_id, item_id, round(list_max(list_transform(range(1, len(same) - size + 2), lambda i: list_sum(same[i:i + size - 1]))) / size, 6) AS agree FROM s),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items, max(agree) AS agree FROM v WHERE agree >= 0.8 GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS items, coalesce(agree, 0)::DOUBLE AS agree, n IS NOT NULL AS contaminated FROM d LEFT JOIN f USING (doc_id)"""


_LM_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, len(w) AS n, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
x AS (SELECT *, count(*) OVER () AS total, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS u,
  CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) END AS bi,
  CASE WHEN a IS NOT NULL THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) END AS tri FROM t),
y AS (SELECT *, lag(u) OVER o AS ub, lag(bi) OVER o AS bb FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p1 AS (SELECT *, greatest(u, 0.5) / greatest(total - n, 1)::DOUBLE AS p FROM y),
p2 AS (SELECT * REPLACE (CASE WHEN b IS NULL THEN p WHEN bi > 0 THEN bi / greatest(ub, 1)::DOUBLE ELSE 0.4 * p END AS p) FROM p1),
p3 AS (SELECT * REPLACE (CASE WHEN a IS NULL THEN p WHEN tri > 0 THEN tri / greatest(bb, 1)::DOUBLE ELSE 0.4 * p END AS p) FROM p2),
s AS (SELECT doc_id, sum(ln(p)) AS s FROM p3 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, round(s, 4) AS log_score, round(s / len(w), 6) AS mean_log_score FROM d LEFT JOIN s USING (doc_id)"""


SQL = {
    "op5_lm_scoring": _LM_SQL,
    "op2_license_scan": _license_sql(),
    "op3_fingerprints": _fingerprint_sql(),
    "op10_decontamination": _decontamination_sql(),
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING count(*) > 1),
hits AS (SELECT DISTINCT win.doc_id, p FROM win JOIN firsts USING (k), unnest(range(i, i + 13)) AS q(p) WHERE m < win.doc_id),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op4_near_dup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least_ USING (doc_id)""",
}
