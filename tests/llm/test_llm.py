"""The training-data operators: SQL on small tables, brute force, round trips, held-out accuracy, odd inputs."""

import base64
import itertools
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lexmill.llm")

from lexmill.llm import queries as Q  # noqa: E402
from lexmill.llm.components import components  # noqa: E402
from lexmill.llm.decontaminate import allowed, decontaminate, masks_for  # noqa: E402
from lexmill.llm.fingerprint import edited_fingerprints, fingerprints  # noqa: E402
from lexmill.llm.language_id import fit, held_out, identify  # noqa: E402
from lexmill.llm.license_scan import license_scan  # noqa: E402
from lexmill.llm.lm_score import lm_score  # noqa: E402
from lexmill.llm.kernels import Words  # noqa: E402
from lexmill.llm.mixing import TARGETS, fit_classifier, form, label_domain, measured, mix, posteriors, proximal, replay, solve  # noqa: E402
from lexmill.llm.near_dup import near_dup  # noqa: E402
from lexmill.llm.pii import find, luhn, patterns_of, redact, rendered  # noqa: E402
from lexmill.llm.substring_dedup import substring_dedup  # noqa: E402
from lexmill.llm.token_counts import VOCABULARY, count_tokens, encoder, file_format, token_counts  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, row string, d string, cls string"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
ODD = [None, "", " \t\n", "one", "one two", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", LONG, LONG + " end", "É \x00 ünï\x0bcode ﬁ 语言 " * 9, "...\n\n--\n", "mail a@b.co, +1 (555) 555-0100, 10.0.0.256, 10.0.0.255, 4111 1111 1111 1111"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None, None, i, "r", "d", "c") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], rows[5], (5, "another text", *rows[5][2:]), (None, "null id", *rows[5][2:]), (None, None, None, None, None, None, None, None, None)], SCHEMA)


def words(t):
    return re.findall(r"[^ \t-\r]+", t or "")


def everywhere(op, df):
    """The operator on odd rows and on no rows."""
    rows = op(df).collect()
    assert op(df.limit(0)).count() == 0
    return rows


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows, cols: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert key([tuple(r) for r in got.collect()], got.columns) == key(want.fetchall(), want.columns)


def test_substring_dedup(spark, odd):
    rows = everywhere(lambda d: substring_dedup(d, window=5), odd)
    assert len(rows) == odd.count()
    seen = {}
    src = [(r.doc_id, words(r.text)) for r in odd.collect()]
    for i, w in src:
        for k in range(len(w) - 4):
            key, v = tuple(w[k : k + 5]), float("inf") if i is None else i
            seen[key] = min(seen.get(key, v), v)
    want = Counter()
    for i, w in src:
        gone = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] < (float("inf") if i is None else i) for p in range(k, k + 5)}
        want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows) == want


def test_lm_score(spark, odd):
    rows = {(r.doc_id, r.n_words): r.log_score for r in everywhere(lm_score, odd)}
    assert rows[1, 0] is None and rows[4, 2] is not None
    docs = spark.createDataFrame([(0, "A b c"), (1, "a b d")], "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in lm_score(docs).collect()}
    # document 0: a -> 1/3, b after a -> 1/1, c unseen elsewhere -> 0.4 * 0.4 * (0.5 / 3)
    assert got[0] == pytest.approx(np.log(1 / 3) + np.log(1) + np.log(0.16 * 0.5 / 3))


def test_near_dup(spark, odd):
    rows = everywhere(lambda d: near_dup(d, shingle=3, percent=85), odd)
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id not in (5, None)}
    assert by[6].component_id == 5 and by[8].component_id == 7 and not by[8].kept
    assert [by[k].component_id for k in range(5)] == list(range(5)) and by[0].n_shingles == 0
    assert by[3].n_shingles == by[4].n_shingles == 1


def test_near_dup_brute_force(spark):
    """Clusters of near copies around the threshold: no link between different texts is lost."""
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randrange(6)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup(docs, shingle=3, percent=85).collect()} == {i: root(i) for i in range(len(texts))}


def test_near_duplicate_stage(spark):
    from corpus_pipeline import near_duplicates

    a, b, c = "one two three four five six seven eight", "other words make another text of some length", "third text here that nobody else has written"
    rows = [(2, a), (1, a), (1, b), (1, b), (3, b), (None, b), (None, c), (None, c), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in near_duplicates(spark, docs, SF).collect())
    assert got == {(1, a): 1, (1, b): 1, (None, c): 1, (4, ""): 2}
    assert near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40), (None, 3)], "a int, b int")
    assert {r["node"]: r["root"] for r in components(e).collect()} == {**{i: 0 for i in range(1, 21)}, 31: 30}


def test_license_scan(spark, odd):
    assert all(r.n_base == 0 and r.base_labels == "" for r in everywhere(license_scan, odd))
    text = "x The MIT License, the mit LICENSE; Apache License, Version 2.0 CC-BY-NC. released under the very mit license"
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 1, 12, "apache-2,cc-by-nc,mit") and 0 < r.score <= 1


def test_fingerprints(spark, odd):
    rows = everywhere(edited_fingerprints, odd)
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    prints = {}
    for r in everywhere(fingerprints, odd):
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[5] & prints[6] and prints[1] != prints[2] and prints[0] == prints[1]
    wide = spark.createDataFrame([(i * 10**15 - 5 * 10**15, f"text {i}") for i in range(9)], "doc_id long, text string")
    got = {r.doc_id: r.edited for r in edited_fingerprints(wide).collect()}
    assert got == {i * 10**15 - 5 * 10**15: f"text {i}"[:4] + "te" for i in range(9)}


def test_decontaminate(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (1, item)], "item_id long, text string")
    assert not any(r.contaminated for r in everywhere(lambda d: decontaminate(d, items), odd))
    assert not any(r.contaminated for r in decontaminate(odd, items.limit(0)).collect())
    changed = item.replace("kappa", "KAPA").replace("beta ", "better ")
    docs = spark.createDataFrame([(1, f"x {item.upper()} y"), (2, f"some words {changed}, and more"), (3, "alpha beta gamma delta then epsilon zeta"), (4, item[6:])], "doc_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate(docs, items).collect()} == {1: True, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("share", [0.8, 0.6, 1.0])
def test_masks_cover(share):
    """Every pattern of allowed substitutions, in windows of all lengths, leaves a seed."""
    for m in range(1, 14):
        assert allowed(m, share) == max(e for e in range(m) if e / m <= 1 - share + 1e-9)
        for gone in itertools.combinations(range(m), allowed(m, share)):
            assert any(not any(c == "1" and i + j in gone for j, c in enumerate(mask)) for mask in masks_for(m, share) for i in range(m - len(mask) + 1)), (m, gone)


def test_decontaminate_all_patterns(spark):
    """Items of 1 to 15 words, every pattern of allowed substitutions in a window, and one too many: as by brute force."""
    items, docs, want = [], [], {}
    for m in (*range(1, 14), 15):
        item, size = [f"i{m}w{k}" for k in range(m)], min(m, 13)
        items.append((m, " ".join(item)))
        for at in {0, m - size}:
            for e in (allowed(size, 0.8), allowed(size, 0.8) + 1):
                for gone in itertools.combinations(range(at, at + size), e):
                    text = ["x" if k in gone or not at <= k < at + size else w for k, w in enumerate(item)]
                    want[len(docs)] = e <= allowed(size, 0.8)
                    docs.append((len(docs), " ".join(["before", *text, "after"])))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate(docs, items).collect()} == want


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_pii(t):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, t or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, odd):
    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choice(["1", "4", "2", "0", ".", "-", " ", "+", "(", ")", "@", "a", "b", ".c", "é", "255", "4111111111111111"]) for _ in range(80)) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in find(docs).select("d.doc_id", rendered(F.col("base")).alias("b")).collect()}
    assert got == {i: brute_pii(t) for i, t in enumerate(texts)}
    assert len(everywhere(find, odd)) == odd.count() and redact(odd).columns == odd.columns
    assert redact(odd).where("doc_id = 11").first().text.startswith("mail <email>, <phone>, 10.0.0.256, <ip>, <card>")


def test_pii_contexts(spark):
    rows = [(i, f"please write to member no. {100000 + i} at user{i}@x.org now, customer id u{i}@mail.org ok") for i in range(20)] + [(99, "the customer id u77x88-q ok, and 123456789 else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["d"].doc_id: r.spans for r in find(docs).collect()}
    new = [rows[-1][1][s.start : s.end] for s in spans[99] if s.kind == 4]
    assert new == ["u77x88-q"]


def test_pii_edge_of_text(spark):
    """Identifiers after one label, after nothing, after a long token or a long gap have patterns too, and no token is cut."""

    def patterns(t, x="u77x88-q"):
        at = t.encode().index(x.encode())
        return patterns_of(t.encode(), at, at + len(x))

    assert patterns("SSN: u77x88-q") == [b"2 \n ssn:", b"m ssn: \n", b"1 ssn:"] and patterns("u77x88-q is") == [b"2 \n \n", b"m \n is"]
    assert patterns("y" * 90 + " u77x88-q") != patterns("y" * 91 + " u77x88-q")
    assert patterns("the Customer" + " " * 99 + "id3 (u77x88-q) ok")[0] == b"2 customer id0"
    assert patterns("a user=u77x88-q b") == [b"p user="]
    rows = [(i, f"Customer: user{i}@mail{i}.org") for i in range(20)] + [(99, "Customer: u77x88-q"), (98, "Customer: Smith")]
    spans = {r["d"].doc_id: r.spans for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[t[s.start : s.end] for s in spans[i] if s.kind == 4] for i, t in rows[-2:]] == [["u77x88-q"], ["Smith"]]


def test_language_id(spark, odd):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = fit(docs.where(~held_out()), "text", "lang", "doc_id")
    tested = identify(docs.where(held_out()), model).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert tested.agg(F.avg("ok")).first()[0] > 0.97
    got = everywhere(lambda d: identify(d, model), odd)
    assert len(got) == odd.count() and {r.lang_pred for r in got if not any(map(str.isalpha, r.text or ""))} == {"und"}
    none = fit(docs.limit(0), "text", "lang", "doc_id")
    assert none is None and {r.lang_pred for r in identify(odd, none).collect()} == {"und"}
    one = fit(docs.where("lang = 'de'"), "text", "lang", "doc_id")
    assert {r.lang_pred for r in identify(docs.limit(5), one).collect()} == {"de"}


def test_token_counts(spark, odd, tmp_path):
    encode = encoder(VOCABULARY).encode_ordinary
    got = Counter((r.doc_id, r.n_tokens) for r in everywhere(lambda d: token_counts(d, block_tokens=1000), odd))
    assert got == Counter((r.doc_id, len(encode(r.text or ""))) for r in odd.collect())
    for name, ids in {"a": [1, 2, 9, 9, 3], "b": [9], "c": [], "d": [1] * 10, "e": [1, 2, 3, 9, 4, 5, 6, 7, 9]}.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in "abcde"], "file string")
    for block in (1, 2, 3, 100):
        got = sorted((r.file[-1], r.ordinal, r.start, r.n_tokens, r.ended) for r in count_tokens(files, eod=9, block_tokens=block).collect())
        assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, False), ("b", 0, 0, 0, True), ("d", 0, 0, 10, False), ("e", 0, 0, 3, True), ("e", 1, 4, 4, True)]


def test_token_query(spark, tmp_path):
    """The registered query against the encoder; a vocabulary of over 65,536 tokens takes four bytes each."""
    encode = encoder(VOCABULARY).encode_ordinary
    docs = {r.doc_id: len(encode(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in Q.op6_token_counts(spark, SF).collect()} == docs
    eod, dtype = file_format(VOCABULARY)
    assert eod == encoder(VOCABULARY).max_token_value + 1 and dtype == "<u2"
    with pytest.raises(ValueError):
        file_format(VOCABULARY, 7)
    wide = tmp_path / "wide.tiktoken"
    single = [bytes([k]) for k in range(256)] + [bytes([97 + k // 26 % 26, 97 + k % 26, *str(k).encode()]) for k in range(70_000)]
    wide.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate(dict.fromkeys(single))))
    assert file_format(str(wide))[1] == "<u4"
    some = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "x y z")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(some, vocabulary=str(wide), block_tokens=2).collect()} == {k: len(encoder(str(wide)).encode_ordinary(t)) for k, t in ((1, "abc"), (2, ""), (3, ""), (4, "x y z"))}


def test_mixing_posteriors(spark):
    """Posteriors against plain sums of word weights; quality on labelled documents the fit doesn't see."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_classifier(docs, labels.where("doc_id % 3 <> 0"), label_domain(), "doc_id", "text", 2000)
    rows = {r.doc_id: r for r in posteriors(docs, model, model.domains, "doc_id", "text").collect()}
    for r in docs.limit(30).collect():
        z = form(pa.array([r.text]))[0] @ model.form
        bins = {int(Words(pa.array([x]), lower=True).hash[0] >> np.uint64(44)) for x in set(words(r.text))}
        z = z + sum(model.words[model.index[b]] for b in bins if model.index[b] >= 0)
        assert rows[r.doc_id].n_tokens == len(words(r.text)) and np.allclose(rows[r.doc_id].p, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-6)


def test_mixing_quality(spark):
    """Domains of labelled documents that the fit doesn't see."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_classifier(docs, labels.where("doc_id % 3 <> 0"), label_domain(), "doc_id", "text", 2000)
    held = labels.where("doc_id % 3 = 0").select("doc_id", label_domain().alias("y")).join(posteriors(docs, model, model.domains, "doc_id", "text"), "doc_id").collect()
    right = [(r.y, model.domains[int(np.argmax(r.p))] == r.y) for r in held]
    assert np.mean([ok for _, ok in right]) > 0.9 and np.mean([ok for y, ok in right if y == "good-toxic"]) > 0.75


def test_scratch_scope(spark):
    from lexmill.llm.scratch import discarded, scratch

    with discarded(spark):
        kept = scratch(spark.range(3))
        path = kept._saved_at.removeprefix("file://")
        assert kept.count() == 3 and Path(path).exists()
    assert not Path(path).exists()


def test_mixing(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    targets = {"good-clean": 0.6, "poor-clean": 0.3, "good-toxic": 0.06, "poor-toxic": 0.04}
    rows = mix(docs, labels, label_domain(), targets, iterations=200).collect()
    t, p, r = (np.array([x[c] for x in rows], float) for c in ("n_tokens", "p", "rate"))
    assert (r >= 0).all() and np.allclose(p.sum(1), 1)
    met = (t * r) @ p / t.sum()
    goal = np.array([targets[d] for d in sorted(targets)])
    # brute force: the same projected gradient on one machine
    steps = []
    for _ in range(200):
        res = (t * replay(p, steps)[1]) @ p / t.sum() - goal
        if np.abs(res).max() < 1e-6:
            break
        steps.append(res)
    assert np.allclose(r, replay(p, steps)[0], atol=1e-6) and np.abs(met - goal).max() < 0.02
    assert len(everywhere(lambda d: mix(d, labels.limit(0), label_domain(), targets, iterations=3), odd)) == odd.count()
    assert fit_classifier(docs, labels.limit(0), label_domain(), "doc_id", "text", 10) is None


def local_rates(n, p, goal):
    """Rates of the solver and its dual numbers, on one machine."""
    n = n / n.sum()
    duals = solve(lambda d, points: measured(n, p, proximal(p, d), points), goal, 1e-6)
    return proximal(p, duals), duals


def test_mixing_targets(spark, odd):
    """With the defaults of op9 the targets are met, and the rates are those nearest to 1."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = mix(docs, labels, label_domain(), TARGETS).collect()
    t, p, r = (np.array([x[c] for x in rows], float) for c in ("n_tokens", "p", "rate"))
    goal = np.array([TARGETS[d] for d in sorted(TARGETS)])
    assert len(rows) == docs.count() and (r >= 0).all() and np.abs((t * r) @ p / t.sum() - goal).max() < 2e-6
    # rates nearest to 1 are max(0, 1 + posterior x u): so the positive ones are linear in the posterior
    on = r > 1e-9
    assert np.allclose(p[on] @ np.linalg.lstsq(p[on], r[on] - 1, rcond=None)[0], r[on] - 1, atol=1e-4)
    assert np.allclose(r, local_rates(t, p, goal)[0], atol=1e-3)
    assert len(everywhere(lambda d: mix(d, labels.limit(0), label_domain(), TARGETS), odd)) == odd.count()
    assert {x.rate for x in mix(odd.where("doc_id < 3"), labels, label_domain(), TARGETS).collect()} == {1.0}


def test_mixing_out_of_reach():
    """Targets that no rates meet: the least squared error is reached (Karush-Kuhn-Tucker)."""
    rng = np.random.default_rng(5)
    for sharp in (1, 3):
        e = np.exp(sharp * rng.normal(size=(300, 4)) + [2, 1, -1, -2])
        p, n = e / e.sum(1, keepdims=True), rng.integers(1, 4000, 300) + 0.0
        for goal in ([1, 0, 0, 0], [0, 0, 0, 1], [0, 0.5, 0, 0.5], [0.7, 0.05, 0.22, 0.03]):
            r = local_rates(n, p, np.array(goal, float))[0]
            residual = (n * r) @ p / n.sum() - goal
            slope = p @ residual
            assert (r >= 0).all() and slope.min() > -1e-6 and abs((n * r / n.sum()) @ slope) < 1e-6
    one = np.array([[0.1, 0.2, 0.3, 0.4]])
    assert local_rates(np.ones(1), one, np.array([0.7, 0.22, 0.05, 0.03]))[0][0] == pytest.approx(0.141 / 0.3, abs=1e-5)


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixing"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = near_dup(docs).where("kept").count()
    left, kept = docs, []
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, left, SF)
        assert out.columns == docs.columns
        left = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(left.count())
    assert kept[0] == docs.count() and kept[1] == near and kept[2] < kept[1] and kept[3] == kept[2]
    assert left.select(F.max(F.col("text").rlike("[A-Za-z0-9]@[a-z]+[0-9]*[.]example").cast("int"))).first()[0] == 0
    assert P.run(spark, SF).count() == kept[3]
