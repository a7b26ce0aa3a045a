"""The methods themselves: hashing, branches, ordered spans, pattern graphs, votes, odd rows in every stage."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lexmill.llm")

from lexmill.llm import queries as Q  # noqa: E402
from lexmill.llm.fingerprint import changed_branches, fingerprints, likeness  # noqa: E402
from lexmill.llm.kernels import Words, exact_shingles  # noqa: E402
from lexmill.llm.language_id import SCALE, fit, held_out, identify  # noqa: E402
from lexmill.llm.license_scan import K, TEMPLATES, license_scan, template_rows  # noqa: E402
from lexmill.llm.lm_score import lm_score  # noqa: E402
from lexmill.llm.near_dup import near_dup  # noqa: E402
from lexmill.llm.pii import base_spans, find, rendered  # noqa: E402
from lexmill.llm.substring_dedup import substring_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 1024, 2048, 4096])
def test_words_that_collide_under_polynomials(spark, n):
    """Two words that agree under any polynomial hash modulo a power of two are two words."""
    x, y = thue_morse(n)
    w = Words(pa.array([x, y, x]), two=True)
    assert w.hash[0] != w.hash[1] and w.hash2[0] != w.hash2[1] and w.hash[0] == w.hash[2]
    docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup(docs, shingle=3, percent=85).collect()} == {1: 1, 2: 2, 3: 1}
    rest = " ".join("bcdefghijklm")
    docs = spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{x} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}


def test_word_hashes(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["x" * k for k in range(200)] + [None, ""]
    w, known, at = Words(pa.array(texts), lower=True, two=True), {}, 0
    for t in texts:
        for word in re.findall(rb"[^ \t-\r]+", (t or "").encode().lower()):
            assert known.setdefault(word, (w.hash[at], w.hash2[at])) == (w.hash[at], w.hash2[at])
            at += 1
    assert at == len(w.hash) and len({a for a, _ in known.values()}) == len({b for _, b in known.values()}) == len(known)
    for t, got in zip(texts, exact_shingles(pa.array(texts), 3)):
        words = re.findall(rb"[^ \t-\r]+", (t or "").encode().lower())
        assert len(got) == len({tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else ())


def test_chunks_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for op in (substring_dedup, lm_score):
        rows = [sorted(map(str, op(docs, chunks=n).collect())) for n in (1, 3, 50)]
        assert rows[0] == rows[1] == rows[2]


def branches(spark, a, b):
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    x, y = (r.fingerprint for r in fingerprints(docs).orderBy("doc_id").collect())
    found, near = spark.range(1).select(changed_branches(F.lit(x), F.lit(y)), likeness(F.lit(x), F.lit(y))).first()
    return [tuple(r) for r in found], near


def test_changed_branches(spark):
    assert branches(spark, "p\n\nq", "p\n\nq") == ([], 1.0)
    assert branches(spark, "p\n\nq", "p\n\nx\n\nq")[0] == [("b", "inserted", 1, None)]
    assert branches(spark, "p\n\nx\n\nq", "p\n\nq")[0] == [("a", "deleted", 1, None)]
    assert branches(spark, "o\n\np\n\nq\n\nr", "o\n\nq\n\np\n\nr")[0] == [("a", "moved", 1, None), ("a", "moved", 2, None), ("b", "moved", 1, None), ("b", "moved", 2, None)]
    assert branches(spark, "a\nb\nc", "a\nx\nc")[0] == [("a", "changed", 0, 1), ("b", "changed", 0, 1)]
    assert branches(spark, "a\nb\nc", "a\nc")[0] == [("a", "changed", 0, 1)]
    assert branches(spark, "s\n\na\nb", "s\n\na\nb\nb\n\nt")[0] == [("b", "changed", 1, 2), ("b", "inserted", 2, None)]
    assert branches(spark, "", "a")[0] == [("a", "changed", 0, 0), ("b", "changed", 0, 0)]
    text = " ".join(f"word{k} of many." for k in range(400))
    found, near = branches(spark, text, "!" + text)
    assert near > 0.99 and found == [("a", "changed", 0, 0), ("b", "changed", 0, 0)]


def longest_chain(matches):
    """Most matches that ascend in both places."""
    best = {}
    for t, p in sorted(matches):
        best[t, p] = 1 + max((n for (a, b), n in best.items() if a < t and b < p), default=0)
    return max(best.values(), default=0)


def test_license_spans_in_order(spark):
    text = dict((label, t) for label, t in TEMPLATES if label == "zlib")["zlib"]
    w = text.split()
    shuffled = list(w)
    random.Random(7).shuffle(shuffled)
    parts = [w[i : i + 8] for i in range(0, len(w), 8)]
    backwards = [x for p in reversed(parts) for x in p]
    gap = w[:40] + ["and", "so"] + w[40:]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, (w, shuffled, backwards, gap, w[: len(w) // 3])))), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    assert [got[k].labels for k in range(5)] == ["zlib", "", "", "zlib", ""] and got[0].score == 1
    assert [(s.start, s.end, s.label) for s in got[3].spans] == [(0, len(w) + 2, "zlib")]


def test_license_brute_force(spark):
    """Scores against the longest chains of each template's matches, diagonals merged by hand."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(9000 + k, f"x {t[: len(t) // 2]} q r {t[len(t) // 2 :]} y") for k, (_, t) in enumerate(TEMPLATES)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    known = collections.defaultdict(list)
    for tid, label, base, grams, t, gram in template_rows():
        known[gram].append((tid, label, base, grams, t))
    for i, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = collections.defaultdict(list)
        for p in range(len(w) - K + 1):
            for tid, label, base, grams, t in known.get(" ".join(w[p : p + K]), ()):
                hits[tid, label, base, grams].append((p - t, t, p))
        labels, score = set(), 0.0
        for (_, label, base, grams), found in hits.items():
            spans, last = [], None
            for diagonal in sorted({x[0] for x in found}):
                if last is None or base or diagonal - last > 3:
                    spans.append(set())
                spans[-1].add(diagonal)
                last = diagonal
            for span in spans:
                share = longest_chain([(t, p) for g, t, p in found if g in span]) / grams
                if share >= (1 if base else 0.6):
                    labels.add(label)
                    score = max(score, share)
        assert got[i].labels == ",".join(sorted(labels)) and got[i].score == pytest.approx(score, abs=0.02)


SPACE = re.compile(r"[^\x20\t\n\r\x0b\x0c]+")
WRAP = "\"'`()[]{}<>,;.!?*"


def brute_contexts(texts, rounds=3, reliable=0.7, support=5, promise=0.1):
    """New spans by text: the pattern graph built and scored in plain dictionaries."""
    mask = lambda x: re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x))
    induced, stands, common, docs = collections.defaultdict(set), collections.Counter(), collections.Counter(), []
    for t in texts:
        base = [(s, e) for _, s, e in base_spans(t)]
        keys = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}", t) if len(re.findall("[0-9]", m[0])) >= 8 and len(re.findall("[A-Za-z]", m[0])) >= 8]
        keys = [(s, e) for s, e in keys if not any(a < e and s < b for a, b in base)]
        tokens = [m.span() for m in SPACE.finditer(t)]
        edges = []
        for s, e in base + keys:
            own = [k for k, (a, b) in enumerate(tokens) if a < e and s < b]
            first, last = own[0], own[-1]
            glued = mask(t[tokens[first][0] : s]).lstrip(WRAP)
            word = lambda k: mask(t[slice(*tokens[k])]) if 0 <= k < len(tokens) else "\n"
            if glued.strip(WRAP):
                names = ["p " + glued] if glued[-1] in "=:" else []
            else:
                one = word(first - 1)
                names = [f"2 {word(first - 2)} {one}", f"m {one} {word(last + 1)}"] + ([f"1 {one}"] if one[-1] in ":=#>|(" else [])
            for p in names:
                induced[p].add(t[s:e].lower())
                stands[p] += 1
                if (s, e) in base:
                    edges.append((p, t[s:e].lower(), True, None))
        docs.append((t, base, keys, tokens, edges))
        word = lambda k: mask(t[slice(*tokens[k])]) if 0 <= k < len(tokens) else "\n"
        for k, (a, b) in enumerate(tokens):
            common.update((f"2 {word(k - 2)} {word(k - 1)}", f"m {word(k - 1)} {word(k + 1)}", f"1 {word(k - 1)}"))
            m = re.match(r".*[=:]", t[a:b], re.DOTALL)
            if m and t[a + m.end() : b].strip(WRAP) and mask(m[0]).strip(WRAP):
                common["p " + mask(m[0]).lstrip(WRAP)] += 1
    patterns = {p for p, found in induced.items() if len(found) >= support and stands[p] >= promise * common[p]}
    graph, places = collections.defaultdict(dict), []
    for n, (t, base, keys, tokens, edges) in enumerate(docs):
        found = [x for x in edges if x[0] in patterns]
        word = lambda k: mask(t[slice(*tokens[k])]) if 0 <= k < len(tokens) else "\n"  # noqa: E731, B023
        for k, (a, b) in enumerate(tokens):
            s, e = b - len(t[a:b].lstrip(WRAP)), a + len(t[a:b].rstrip(WRAP))
            spans = [(p, s, e) for p in (f"2 {word(k - 2)} {word(k - 1)}", f"m {word(k - 1)} {word(k + 1)}", f"1 {word(k - 1)}")]
            if m := re.match(r".*[=:]", t[a:b], re.DOTALL):
                x = a + m.end()
                y = x + len(t[x:b].rstrip(WRAP))
                spans.append(("p " + mask(m[0]).lstrip(WRAP), y - len(t[x:y].lstrip(WRAP)), y))
            for p, s, e in spans:
                if p in patterns and s < e and not any(c < e and s < d for c, d in base):
                    found.append((p, t[s:e].lower(), any(c < e and s < d for c, d in keys), (n, s, e)))
        for p, x, seed, place in found:
            graph[p][x] = graph[p].get(x, False) or seed
            places.append((p, x, place))
    seeds = {x for g in graph.values() for x, seed in g.items() if seed}
    conf = {x: float(x in seeds) for g in graph.values() for x in g}
    for r in range(rounds):
        score = {p: sum(conf[x] for x in g) / (len(g) + 1) for p, g in graph.items()}
        if r < rounds - 1:
            conf = {x: 1.0 if x in seeds else max((score[p] for p, g in graph.items() if x in g and len(g) >= support), default=0.0) for x in conf}
    good = {p for p, g in graph.items() if len(g) >= support and score[p] >= reliable}
    out = collections.defaultdict(set)
    for p, _, place in places:
        if p in good and place:
            out[place[0]].add(f"context:{place[1]}:{place[2]}")
    return [sorted(out[n], key=lambda x: [int(y) for y in x.split(":")[1:]]) for n in range(len(texts))]


def contexts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in find(docs).select("d.doc_id", rendered(F.col("spans")).alias("s")).collect()}
    return [[x for x in got[n].split(",") if x.startswith("context")] for n in range(len(texts))]


def test_pii_graph_brute_force(spark):
    rng = random.Random(11)
    some = lambda: rng.choice(["the", "of", "a", "Zoë", "id:", "key", "=", '"', "no.", "7"])
    entity = lambda k: rng.choice([f"u{k}@mail{k}.org", f"10.0.{k % 250}.{rng.randrange(250)}", f"+1 555 010 {1000 + k}", "%040x" % rng.getrandbits(160), f"Name{k}", "x" * 90, f"\"{'%036x' % rng.getrandbits(144)}\""])
    texts = []
    for k in range(400):
        words = []
        for _ in range(rng.randrange(1, 9)):
            words += [some() for _ in range(rng.randrange(3))] + rng.choice([["contact", "mail:"], ["token", "="], ["see"], []])
            words.append(rng.choice(["", "user=", "(id:"]) + entity(k))
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    want = brute_contexts(texts)
    assert contexts(spark, texts) == want and sum(map(len, want)) > 100


def test_pii_query_brute_force(spark):
    """The registered query on a whole table: base spans as they are, the method's spans as by brute force."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect()
    want = dict(zip((r.doc_id for r in docs), brute_contexts([r.text for r in docs])))
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("context")] for r in Q.op7_pii(spark, sf).collect()}
    assert got == want and sum(map(len, want.values())) > 10


def test_pii_without_broadcast(spark, monkeypatch):
    """Beyond the bounds the joins find the same."""
    texts = [f"write to member mail: user{k}@mail{k}.org now" for k in range(9)] + ["ask member mail: nobody-77 now", None, ""]
    want = contexts(spark, texts)
    monkeypatch.setattr("lexmill.llm.pii.BROADCAST_PATTERNS", 0)
    monkeypatch.setattr("lexmill.llm.pii.BROADCAST_TEXTS", 0)
    assert contexts(spark, texts) == want and want[9] == ["context:17:26"]


def test_language_votes_brute_force(spark):
    """Every prediction against trigram means and votes counted in plain loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs.where(~held_out()), "text", "lang", "doc_id")
    for r in identify(docs.select("doc_id", "text").limit(40), model).collect():
        raw = [c if c > 127 or chr(c).isalpha() else 32 for c in (r.text or "").lower().encode()]
        total, n = np.zeros(len(model.pairs)), 0
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            if a != 32 or b != 32:
                total += model.weights[((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 20] * SCALE
                n += 1
        margin = total / max(n, 1) + np.array(model.bias)

        def vote(group, margin=margin):
            wins, sums = collections.Counter(), collections.Counter()
            for a, b in itertools.combinations(group, 2):
                m = margin[model.pairs.index((a, b))]
                wins[a if m > 0 else b] += 1
                sums[a] += m
                sums[b] -= m
            return max(group, key=lambda x: (wins[x], sums[x]))

        family = vote(list(model.members))
        assert r.lang_pred == (vote(model.members[family]) if any(map(str.isalpha, r.text or "")) else "und")


CLASH = "doc_id long, text string, lang string, source string, n_chars long, d string, i int, t string, tie long, _id int, _tie int, lang_pred string, score double, k1 long, pattern string, base int, spans int, kind int, row long, cls string, h long"
STAGE_TEXTS = [None, "", " \n ", "...", "one", "two words", "a b c d e f g h", "a b c d e f g h", "mail x@y.org now", "long " * 20_000, "née und der die 語"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rest = ("d", 1, "t", 5, 6, 7, "zz", 0.5, 8, "p", 9, 10, 11, 12, "c", 13)
    rows = [(i, t, "en" if i % 2 else None, None, None, *rest) for i, t in enumerate(STAGE_TEXTS)]
    rows += [rows[6], rows[6], (6, "another text of the same id", *rows[6][2:]), (None, "null id text here for all", *rows[6][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, CLASH)


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "decontamination", "personal_data", "mixing"])
def test_stage_on_odd_rows(spark, odd_docs, stage):
    import corpus_pipeline as P

    apply = dict(P.STAGES)[stage]
    rows = apply(spark, odd_docs, SF).collect()
    assert apply(spark, odd_docs.limit(0), SF).count() == 0
    key = collections.Counter((r.doc_id, r["text"] if stage != "mixing" else None) for r in rows)
    n = odd_docs.count()
    if stage == "mixing":
        assert len(rows) == n and all(r.rate >= 0 for r in rows)
        return
    assert apply(spark, odd_docs, SF).columns == odd_docs.columns and all((r.d, r.lang_pred, r.score, r.kind) == ("d", "zz", 0.5, 11) for r in rows)
    if stage == "language":
        assert len(rows) == n - 5 and all(any(map(str.isalpha, r.text)) for r in rows)
    elif stage == "near_duplicates":
        # of the rows equal in id and text one stays, and of those with equal words the least id; wordless ones stay
        assert len(rows) == n - 3 and key[6, STAGE_TEXTS[6]] == 1 and (7, STAGE_TEXTS[7]) not in key and key[None, None] == 1
    elif stage == "decontamination":
        assert len(rows) == n
    else:
        assert len(rows) == n and key[8, "mail <email> now"] == 1
        assert {r.doc_id: r.n_chars for r in rows}[8] == len("mail <email> now")


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def holds_passage(text, items):
    """Whether a window of min(length, 13) words of an item agrees with the text in four fifths of its words, in place."""
    w = letter_words(text)
    at = collections.defaultdict(list)
    for p, x in enumerate(w):
        at[x].append(p)
    for item in items:
        size = min(len(item), 13)
        votes = collections.defaultdict(set)
        for k, x in enumerate(item):
            for p in at.get(x, ()):
                votes[p - k].add(k)
        for same in votes.values():
            if len(same) >= 0.8 * size and any(sum(k in same for k in range(i, i + size)) >= 0.8 * size - 1e-9 for i in range(len(item) - size + 1)):
                return True
    return False


def test_pipeline_brute_force(spark):
    """All stages on one machine in plain Python: who stays, the cleaned texts, the tokens that are mixed."""
    import corpus_pipeline as P

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := letter_words(r.text))]
    left = {i: t for i, t in docs.items() if any(map(str.isalpha, t or ""))}
    sets = {}
    for i, t in left.items():
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = group[a], group[b]
            group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i}
    left = {i: t for i, t in left.items() if not holds_passage(t, items)}
    ids = sorted(left)
    clean = {}
    for i, found in zip(ids, brute_contexts([left[i] for i in ids])):
        spans = [(s, e, ("email", "ip", "card", "phone")[k]) for k, s, e in base_spans(left[i])] + [(*map(int, x.split(":")[1:]), "context") for x in found]
        out, end = [], 0
        for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
            if s >= end:
                out += [left[i][end:s], f"<{kind}>"]
            end = max(end, e)
        clean[i] = "".join([*out, left[i][end:]])
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, SF).collect(), rows.schema)
    assert {r.doc_id: r.text for r in rows.collect()} == clean and all(r.n_chars == len(r.text) for r in rows.collect())
    mixed = P.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in mixed} == {i: len(re.findall(r"[^ \t-\r]+", t)) for i, t in clean.items()}
    tokens, p, rate = (np.array([x[c] for x in mixed], float) for c in ("n_tokens", "p", "rate"))
    goal = np.array([P.TARGETS[d] for d in sorted(P.TARGETS)])
    residual = (tokens * rate) @ p / tokens.sum() - goal
    # least squares over nonnegative rates: no rate can move the sums nearer to their targets
    slope = p @ residual
    assert (rate >= 0).all() and (np.abs(residual).max() < 1e-5 or slope.min() > -1e-5 and np.abs(slope[rate > 1e-9]).max() < 1e-5)


def variants(rng, many, words, edits):
    """Texts of one base with so many of its words replaced, so that few are linked."""
    base = [f"w{rng.randrange(9000)}" for _ in range(words)]
    for _ in range(many):
        t = list(base)
        for at in rng.sample(range(words), rng.choice(edits)):
            t[at] = f"e{rng.randrange(10**6)}"
        yield " ".join(t)


def linked_components(texts, refused=()):
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        c = len(sets[a] & sets[b])
        if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c) and label[a] != label[b] and (a, b) not in refused:
            x, y = sorted((label[a], label[b]))
            label = [x if k == y else k for k in label]
    return dict(enumerate(label))


@pytest.mark.parametrize("tile", [None, 3000])
def test_buckets_of_unlinked_copies(spark, monkeypatch, tile):
    """Values are met for few pairs, however many unlinked members a bucket has; no link is lost, in tiles neither."""
    from lexmill.llm import near_dup as N

    rng, met, plain = random.Random(5), [], N._met
    texts = [*variants(rng, 160, 200, (0, 5, 6, 18, 20)), *variants(rng, 20, 120, (2, 3, 8)), "a b", "a b c"]
    rng.shuffle(texts)
    monkeypatch.setattr(N, "_met", lambda pairs, values: met.append(pairs.count()) or plain(pairs, values))
    if tile:
        monkeypatch.setattr(N, "TILE", tile)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = linked_components(texts)
    assert len({*want.values()}) > 60
    assert {r.doc_id: r.component_id for r in near_dup(docs, shingle=3, percent=85).collect()} == want
    assert sum(met) < 13 * len(texts)


def test_pairs_not_confirmed(spark, monkeypatch):
    """A bucket goes on without the pairs that words don't confirm: what connects in another way still does."""
    from lexmill.llm import near_dup as N

    rng, plain, refused, rounds = random.Random(8), N._verified, set(), []
    texts = list(variants(rng, 60, 150, (1, 1, 2, 3)))

    def verified(pairs, classes, *rest):
        # of the first round none, of the second every second one isn't confirmed
        doc, found = {r.cls: r.min_doc for r in classes.collect()}, sorted((r.m, r.c) for r in pairs.collect())
        wrong = [found, found[::2], *[[]] * 9][len(rounds)]
        rounds.append({*found})
        refused.difference_update(tuple(sorted((doc[m], doc[c]))) for m, c in found)
        refused.update(tuple(sorted((doc[m], doc[c]))) for m, c in wrong)
        return plain(pairs, classes, *rest).where(~F.concat_ws(",", "m", "c").isin([f"{m},{c}" for m, c in wrong] or [""]))

    monkeypatch.setattr(N, "_verified", verified)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup(docs, shingle=3, percent=85).collect()}
    assert len(rounds) > 2 and len(rounds[1]) > 4 and not rounds[2] & {*sorted(rounds[1])[::2]}
    assert got == linked_components(texts, refused)


def test_forest_against_all_pairs():
    from lexmill.llm.near_dup import _Tokens, forest

    rng = random.Random(11)
    for case in range(40):
        top = rng.choice((30, 2000))
        base = sorted(rng.choices(range(top), k=60))
        sets = [np.sort(np.array([x for x in base if rng.random() > 0.06] + rng.choices(range(top), k=rng.choice((1, 3, 9)))).astype("<u2")) for _ in range(rng.choice((2, 5, 40)))]
        root, tile = np.array([rng.randrange(len(sets)) for _ in sets]), np.array([rng.randrange(2) for _ in sets])
        bad = {k: np.array([y]) for k in range(len(sets)) if (y := rng.randrange(len(sets))) != k}
        refused = {frozenset((k, int(y[0]))) for k, y in bad.items()}
        for k, y in list(refused and map(tuple, refused)):
            bad[k], bad[y] = np.union1d(bad.get(k, []), [y]), np.union1d(bad.get(y, []), [k])
        counts = [collections.Counter(s.tolist()) for s in sets]
        may = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if root[a] != root[b] and tile[a] != tile[b] and frozenset((a, b)) not in refused and 185 * (counts[a] & counts[b]).total() >= 85 * (len(sets[a]) + len(sets[b]))]
        got = forest(_Tokens([s.tobytes() for s in sets]), np.arange(len(sets)), root, 85, tile, bad)

        def parts(pairs):
            label = root.copy()
            for a, b in pairs:
                label[label == label[b]] = label[a]
            return {frozenset(np.flatnonzero(label == x).tolist()) for x in label.tolist()}

        assert {tuple(sorted(p)) for p in got} <= {*may} and parts(got) == parts(may) and len(got) < len(sets), case


def test_fingerprints_once(spark):
    """Texts are shuffled once, and likeness takes the leaves from the tree; pairs across runs of ids are right."""
    from lexmill.llm.fingerprint import edited_fingerprints

    rng, sc = random.Random(2), spark.sparkContext
    texts = {i: f"{rng.getrandbits(6000):x}. {i}" for i in [*range(-70, 500), 10**9, 10**12, 2**62]}
    rows = list(texts.items())
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    df = edited_fingerprints(docs)
    got = {r.doc_id: r for r in df.collect()}
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 1.3 * sum(map(len, texts.values()))
    assert "regexp_extract_all(regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    ids = sorted(texts, reverse=True)
    prints = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, r = texts[i], got[i]
        assert r.edited == t[: len(t) - len(t) // 3] + texts[after][: len(t) // 3] and r.n_chars == len(t) and r.fingerprint == prints[i]
    near = docs.sparkSession.createDataFrame([(i, prints[i], got[i].edited_fingerprint, prints[after]) for i, after in zip(ids, ids[1:] + ids[:1])], "i long, a string, b string, c string")
    for r in near.select("i", likeness(F.col("a"), F.col("b")).alias("b"), likeness(F.col("a"), F.col("c")).alias("c")).collect():
        assert (got[r.i].near_edited, got[r.i].near_next) == (r.b, r.c)


def python_traffic(df) -> tuple[int, int]:
    """Bytes sent to and received from Python by a plan that has run."""
    sent, got = 0, 0
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
            continue
        metrics, children = node.metrics(), node.children()
        if metrics.contains("pythonDataSent"):
            sent, got = sent + metrics.apply("pythonDataSent").value(), got + metrics.apply("pythonDataReceived").value()
        nodes += [children.apply(k) for k in range(children.size())]
    return sent, got


def test_rows_stay_out_of_python(spark):
    """Language and personal data send each text to Python once at most, and no other column; texts come back only where they change."""
    import corpus_pipeline as P
    from lexmill.llm.pii import _searched, redact

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("ballast", F.repeat("text", 3))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    for made, once, back in ((P.language(spark, docs, SF), 1.1, 0.1), (_searched(docs, "text", docs.columns), 1.1, 0.2), (redact(docs), 0.9, 0.9)):
        assert len(made.collect()) == docs.count()
        sent, got = python_traffic(made)
        assert 0 < sent < once * size and 0 < got < back * size
