"""Language identification by hierarchical discrimination.

A first stage of one-versus-one linear support vector machines tells language families apart, a
second one separates the languages within the family found. Features are hashed byte trigrams of
the lower-cased letters of the whole text; the vote with most wins counts, ties by summed margin.

The machines are fitted on the driver on at most ``per_language`` labelled texts of each language
(the ones of least id hash, a bounded documented sample); every text is scored whole. Ids and
sources are never inputs.

Defined cases: a null text and one without letters give ``und``, score 0; null labels aren't
learned from; with no labelled text all is ``und``, with one language all lettered texts get it;
texts with letters but fewer than three bytes are scored by the intercepts alone; rows that
repeat an id are judged by their own texts; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import name
from .features import DIM, mean_weights, shares, squared_hinge, trigram_bins
from .kernels import sliced

#: Families by ISO 639-1 code; a language that isn't listed is its own family.
FAMILIES = {c: f for f, cs in {"germanic": "en de nl sv da no nb nn is af fy lb yi", "romance": "fr es it pt ro ca gl oc la", "slavic": "ru uk pl cs sk bg sr hr sl mk be bs", "uralic": "fi hu et", "turkic": "tr az kk uz tk ky", "indic": "hi ur bn pa gu mr ne si", "semitic": "ar he mt am", "celtic": "cy ga gd br"}.items() for c in cs.split()}


def sample(labelled: DataFrame, label: str, key: str, per_label: int, tie: tuple = ()) -> DataFrame:
    """At most ``per_label`` rows of each label, those of least key hash, rows of one key in the order of ``tie``; labels are counted first, so no label's rows gather in one task."""
    counts = labelled.groupBy(label).count().where("count > 0")
    share = F.least(F.lit(1.0), F.lit(1.5 * per_label + 20) / F.col("count"))
    hashed = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_003))
    some = labelled.join(F.broadcast(counts.select(F.col(label).alias("_label"), share.alias("_share"))), F.col(label) == F.col("_label")).where(hashed <= F.col("_share") * 1_000_003)
    nth = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(17)), F.col(key), *tie))
    return some.withColumn("_nth", nth).where(F.col("_nth") <= per_label).drop("_label", "_share", "_nth")


class Model:
    """Pairwise machines: columns of ``weights`` (per trigram bin) with the labels each tells apart."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        family = {c: FAMILIES.get(c, c) for c in self.languages}
        self.members = {f: [c for c in self.languages if family[c] == f] for f in sorted(set(family.values()))}
        y, columns, self.bias, self.pairs = np.array(labels), [], [], []
        fam = np.array([family[c] for c in labels])
        for group, of in [(sorted(self.members), fam), *((m, y) for m in self.members.values())]:
            for a, b in combinations(group, 2):
                use = (of == a) | (of == b)
                w, c = squared_hinge(x[use], np.where(of[use] == a, 1.0, -1.0))
                columns.append(w)
                self.bias.append(c)
                self.pairs.append((a, b))
        self.weights = np.array(columns).T.reshape(DIM, len(columns))

    def _vote(self, group, margins, n):
        if len(group) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        wins, sums = np.zeros((n, len(group))), np.zeros((n, len(group)))
        for a, b in combinations(group, 2):
            m = margins[:, self.pairs.index((a, b))]
            for lang, s in ((a, m), (b, -m)):
                k = group.index(lang)
                wins[:, k] += s > 0
                sums[:, k] += s
        best = (wins + 0.5 * sums / (1e-9 + np.abs(sums).max(1, keepdims=True))).argmax(1)
        return best, 1 / (1 + np.exp(-4 * np.clip(sums[np.arange(n), best] / (len(group) - 1), -20, 20)))

    def predict(self, means: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(means)
        margins = means + np.array(self.bias)
        families = list(self.members)
        family, sure = self._vote(families, margins, n)
        langs, score = np.empty(n, object), np.zeros(n)
        for k, f in enumerate(families):
            at = np.flatnonzero(family == k)
            best, s = self._vote(self.members[f], margins[at], len(at))
            langs[at] = np.array(self.members[f], object)[best]
            score[at] = sure[at] * s
        return langs.tolist(), score


def fit(labelled: DataFrame, text_col: str, label_col: str, id_col: str, per_language: int = 400) -> Model | None:
    rows = labelled.select(name(id_col).alias("k"), name(text_col).alias("t"), name(label_col).alias("l")).where("t is not null and l is not null")
    schema = pa.schema([("l", pa.string()), ("x", pa.binary())])

    def kernel(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shares(b.column(1)), pa.binary())], schema=schema)

    got = sample(rows, "l", "k", per_language, (F.xxhash64("t"), F.col("t"))).select("l", "t").mapInArrow(kernel, "l string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.l, r.x))
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).astype(np.float64) ** 2
    return Model(x * SCALE, [r.l for r in got])


SCALE = 60.0


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` with lang_pred and score (columns of these names are replaced)."""
    found = identified(docs, model, text_col)
    return found.select(*(F.col("d").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")), "lang_pred", "score")


_PREDICTION = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """(d, lang_pred, score): each row as a struct, with its prediction. Only texts go to Python, only predictions come back."""

    def kernel(texts):
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
        langs, score = [None] * len(texts), np.zeros(len(texts))
        if model:
            if model.pairs:
                _, means = mean_weights(texts, (model.weights * SCALE).astype(np.float32), trigram_bins)
            else:
                means = np.zeros((len(texts), 0))
            langs, score = model.predict(means)
        langs = [x if x and ok else "und" for x, ok in zip(langs, lettered)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.where([x != "und" for x in langs], score, 0.0), pa.float64())], fields=list(_PREDICTION))

    def predicted(texts: pa.Array) -> pa.Array:
        return sliced(kernel, _PREDICTION, texts, rows=2048)

    # "not deterministic" keeps Spark from predicting a text again wherever its prediction is read
    predict = F.arrow_udf(predicted, "lang_pred string, score double").asNondeterministic()
    found = docs.select(F.struct(*(name(c) for c in docs.columns)).alias("d"), predict(name(text_col).cast("string")).alias("p"))
    return found.select("d", "p.lang_pred", F.round("p.score", 6).alias("score"))


def held_out(id_col: str = "doc_id"):
    """The fixed fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(name(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))
