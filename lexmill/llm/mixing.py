"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table predicts each document's domain posteriors; then
nonnegative document rates are fitted so that the expected tokens of each domain, the sum of
rate x tokens x posterior, meet their targets: of the rates of least squared error those nearest
to 1 in the metric of the documents' token shares. There a rate is max(0, 1 + posterior x u), so
the fit is a search for one number u per domain: Newton steps on the convex dual, each one pass
over (tokens, posterior) that tries several step lengths at once. Only sums over the documents
go to the driver. Where no rates meet the targets, u is bounded by a proximal term and the next
search starts from the rates found (``proximal``); the fit ends only when the targets are met or
the duality gap shows that no other rates come nearer. With ``iterations`` given, so many steps
of accelerated projected gradient from rate 1 are taken instead (``replay``), converged or not.

The classifier (softmax regression on form and on the presence of the words that tell the domains
apart best) is fitted on the driver on at most ``sample_rows`` labelled documents, those of least
id hash; posteriors cover all documents.

Defined cases: null and empty texts have 0 tokens and get the rate of their posterior (1 if no text has tokens); labels
with a null id or domain are ignored; a document labelled twice counts with its least domain, a labelled
id of several rows with the text of least hash;
without labels the posterior is equal over the target's domains; targets that no nonnegative
rates meet are met as nearly as any rates can; rows that repeat an id are judged by their own
texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import name
from .kernels import U, Words, bounded, text_buffer
from .scratch import scratch

_FORM = 6
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58)]] = 1
_KIND[[10]] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_KIND[[*range(65, 91)]] = 4


def form(column) -> np.ndarray:
    """Shares of digits, line ends, symbols and capitals, log length, and a constant."""
    data, off = text_buffer(column)
    n = np.diff(off)
    out = np.ones((len(n), _FORM))
    for k in range(1, 5):
        run = np.concatenate([[0], np.cumsum(_KIND[data[off[0] : off[-1]]] == k)])
        out[:, k - 1] = 4 * (run[off[1:] - off[0]] - run[off[:-1] - off[0]]) / np.maximum(n, 1)
    out[:, 4] = np.log1p(n) / 10
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: Words are told apart by 20 bits of their hashes; the classifier looks at ``features`` of these bins.
BINS = 1 << 20


def word_sets(column, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words by document, document, bin) of the distinct bins of each document; with ``index`` only of bins with a number, which is given instead."""
    w = Words(column, lower=True)
    bins, doc = (w.hash >> U(44)).astype(np.int64), w.doc()
    if index is not None:
        bins = index[bins]
        doc, bins = doc[bins >= 0], bins[bins >= 0]
    key = np.unique(doc << 20 | bins)
    return w.n, key >> 20, key & (BINS - 1)


class Classifier:
    """Softmax regression on the presence of telling words and on form."""

    def __init__(self, sets: list[np.ndarray], forms: np.ndarray, labels: list[str], features: int = 2000, ridge: float = 3e-3, steps: int = 300):
        self.domains = sorted(set(labels))
        y = np.eye(len(self.domains))[[self.domains.index(x) for x in labels]]
        seen = np.array([np.bincount(np.concatenate([s for s, has in zip(sets, y[:, k]) if has]), minlength=BINS) for k in range(y.shape[1])]).T
        total = seen.sum(1)
        expected = total[:, None] * y.mean(0)
        tells = np.where(total >= 3, ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(1), -1)
        chosen = np.argsort(-tells, kind="stable")[:features]
        chosen = np.sort(chosen[tells[chosen] > 0])
        self.index = np.full(BINS, -1, np.int16)
        self.index[chosen] = np.arange(len(chosen))
        x = np.zeros((len(sets), len(chosen) + _FORM))
        for row, s in zip(x, sets):
            at = self.index[s]
            row[at[at >= 0]] = 1
        x[:, len(chosen) :] = forms
        scale = 1 / (np.sqrt((x**2).mean(0)) + 0.02)
        z = x * scale
        step = 1 / (0.5 * np.linalg.norm(z, 2) ** 2 / len(z) + ridge)
        w = v = np.zeros((z.shape[1], y.shape[1]))
        t = 1.0
        for _ in range(steps):  # accelerated gradient descent
            new = v - step * (z.T @ ((softmax(z @ v) - y) / len(z)) + ridge * v)
            nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
            v, w, t = new + (t - 1) / nt * (new - w), new, nt
        w = w * scale[:, None]
        self.words, self.form = w[: len(chosen)], w[len(chosen) :]

    def posterior(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(words by document, posterior by document and domain)."""
        n, doc, at = word_sets(column, self.index)
        z = form(column) @ self.form
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(doc, self.words[at, k], minlength=len(n))
        return n, softmax(z)


def fit_classifier(docs: DataFrame, labels: DataFrame, domain, id_col: str, text_col: str, sample_rows: int) -> Classifier | None:
    """A classifier fitted on the driver on the labelled sample; None without labels."""
    some = labels.select(name("doc_id").cast("long").alias("k"), domain.alias("domain")).where("k is not null and domain is not null").groupBy("k").agg(F.min("domain").alias("domain"))
    some = some.orderBy(F.xxhash64("k"), "k").limit(sample_rows)  # bounded, so it may be broadcast
    text = docs.select(name(id_col).cast("long").alias("k"), name(text_col).cast("string").alias("t")).where("t is not null")
    schema = pa.schema([("l", pa.string()), ("x", pa.binary()), ("f", pa.list_(pa.float64()))])

    def kernel(batches):
        for b in bounded(batches, 1):
            n, doc, bins = word_sets(b.column(1))
            parts = np.split(bins.astype(np.int32), np.searchsorted(doc, np.arange(1, len(n))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(form(b.column(1)).tolist(), pa.list_(pa.float64()))], schema=schema)

    got = text.join(F.broadcast(some), "k").groupBy("k", "domain").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x")).select("domain", "x.t").mapInArrow(kernel, "l string, x binary, f array<double>").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.l, r.x))
    return Classifier([np.frombuffer(r.x, np.int32) for r in got], np.array([r.f for r in got]), [r.l for r in got])


def posteriors(docs: DataFrame, model: Classifier | None, domains: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_tokens, p): whitespace tokens and posterior in the order of ``domains``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])

    def kernel(batches):
        for b in bounded(batches, 1):
            if model:
                n, q = model.posterior(b.column(1))
                p = np.array([q[:, model.domains.index(d)] if d in model.domains else np.zeros(len(n)) for d in domains]).T.reshape(len(n), len(domains))
            else:
                n = word_sets(b.column(1))[0]
                p = np.full((len(n), len(domains)), 1 / len(domains))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], schema=schema)

    return docs.select(name(id_col).cast("long").alias("doc_id"), name(text_col).cast("string").alias("text")).mapInArrow(kernel, "doc_id long, n_tokens long, p array<double>")


def replay(p: np.ndarray, residuals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rate, extrapolated rate) after the projected steps with these residuals."""
    r = y = np.ones(len(p))
    t = 1.0
    for res in residuals:
        new, nt = np.maximum(0, y - p @ res), (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, r, t = new + (t - 1) / nt * (new - r), new, nt
    return r, y


def proximal(p: np.ndarray, duals: list[np.ndarray]) -> np.ndarray:
    """Rates after the proximal steps with these dual numbers."""
    r = np.ones(len(p))
    for u in duals:
        r = np.maximum(0, r + p @ u)
    return r


#: Step lengths tried in one pass.
_LENGTHS = np.array([1, 0.7, 0.5, 0.3, *(10.0 ** -np.arange(1, 13)), 0])


def measured(n: np.ndarray, p: np.ndarray, center: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Per point: half the weighted sum of squared rates, domain sums, their derivatives; and the largest posterior x point."""
    out = []
    for u in points:
        z = p @ u
        r = np.maximum(0, center + z)
        q = p * (n * (r > 0))[:, None]
        out.append(np.concatenate([[0.5 * (n * r) @ r], (n * r) @ p, (q.T @ p).ravel(), [z[n > 0].max(initial=-np.inf)]]))
    return np.array(out)


def solve(measure, goal: np.ndarray, tolerance: float, weight: float = 1e-9, passes: int = 500) -> list[np.ndarray]:
    """Dual numbers of the proximal steps that reach the targets or the least squared error.

    ``measure(duals, points)`` is ``measured`` over all documents, in shares of all tokens.
    """
    k = len(goal)
    duals: list[np.ndarray] = []
    points, step, past = np.zeros((1, k)), None, 0.0
    for _ in range(passes):
        got = measure(duals, points)
        slopes = got[:, 1 : k + 1] - goal + weight * points
        if step is None:
            at = int((got[:, 0] + 0.5 * weight * (points**2).sum(1) - points @ goal).argmin())
        else:  # the longest step that doesn't lead past the least value along it
            at = int((slopes @ step <= 0.1 * past).argmax())
        u, residual, slope, hess, top = points[at], got[at, 1 : k + 1] - goal, slopes[at], got[at, k + 1 : -1].reshape(k, k), got[at, -1]
        # posteriors sum to 1, so this is a feasible dual point: it bounds the least squared error from below
        lift = max(0.0, weight * top) - weight * u
        gap = 0.5 * residual @ residual + 0.5 * lift @ lift + lift @ goal
        if np.abs(residual).max() < tolerance or 2 * gap <= tolerance**2:
            return [*duals, u]
        if np.abs(slope).max() < 0.01 * tolerance + 1e-15 * np.abs(u).max() or step is not None and at == len(points) - 1:
            duals, weight, step = [*duals, u], max(0.1 * weight, 1e-16), None
            points = np.array([np.zeros(k), u, 10 * u])
        else:
            step = -np.linalg.solve(hess + weight * np.eye(k), slope)
            past = abs(slope @ step)
            points = u + _LENGTHS[:, None] * step
    raise RuntimeError(f"mixing rates not optimal after {passes} passes: residual {residual.tolist()}, gap {gap}")


def mix(docs: DataFrame, labels: DataFrame, domain, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, iterations: int | None = None, tolerance: float = 1e-6, size: float = 1.0) -> DataFrame:
    """One row per document: doc_id, n_tokens, p (posterior by sorted domain), rate.

    ``targets`` gives each domain's share of ``size`` times all tokens; domains known to
    the classifier but not named get 0.
    """
    model = fit_classifier(docs, labels, domain, id_col, text_col, sample_rows)
    domains = sorted({*targets, *(model.domains if model else ())})
    total_share = sum(targets.values()) or 1.0
    goal = np.array([targets.get(d, 0.0) * size / total_share for d in domains])
    table = scratch(posteriors(docs, model, domains, id_col, text_col), "posteriors")
    tokens = table.agg(F.sum("n_tokens")).first()[0] or 0
    total = tokens or 1
    steps: list[np.ndarray] = []
    schema = pa.schema([("s", pa.list_(pa.float64()))])
    arrays = lambda b, c: np.array(b.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, len(domains))

    def measure(duals, points):
        k = len(domains)

        def sums(batches):
            s = np.zeros((len(points), k * k + k + 2))
            s[:, -1] = -np.inf
            for b in batches:
                p = arrays(b, 1)
                m = measured(b.column(0).to_numpy(zero_copy_only=False) / total, p, proximal(p, duals), points)
                s = np.column_stack([s[:, :-1] + m[:, :-1], np.maximum(s[:, -1], m[:, -1])])
            yield pa.RecordBatch.from_arrays([pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], schema=schema)

        parts = table.select("n_tokens", "p").mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("pos", "v"))
        got = np.zeros((len(points), k * k + k + 2))
        for r in parts.groupBy("pos").agg(F.sum("v").alias("sum"), F.max("v").alias("top")).collect():
            i, j = divmod(r.pos, got.shape[1])
            got[i, j] = r["top"] if j == got.shape[1] - 1 else r["sum"]
        return got

    if iterations is None:
        duals = solve(measure, goal, tolerance) if tokens else []
    for _ in range(iterations or 0):
        done = list(steps)

        def sums(batches, done=done):
            s = np.zeros(len(domains))
            for b in batches:
                p = arrays(b, 1)
                s += (b.column(0).to_numpy(zero_copy_only=False) * replay(p, done)[1]) @ p
            yield pa.RecordBatch.from_arrays([pa.array([s.tolist()], pa.list_(pa.float64()))], schema=schema)

        parts = table.select("n_tokens", "p").mapInArrow(sums, "s array<double>")
        row = parts.agg(*(F.sum(F.get("s", k)).alias(str(k)) for k in range(len(domains)))).first()
        residual = np.array([v or 0.0 for v in row]) / total - goal
        if np.abs(residual).max() < tolerance:
            break
        steps.append(residual)

    def rates(batches):
        for b in batches:
            p = arrays(b, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(proximal(p, duals) if iterations is None else replay(p, steps)[0])], names=["doc_id", "n_tokens", "p", "rate"])

    return table.mapInArrow(rates, "doc_id long, n_tokens long, p array<double>, rate double")


#: Default domains of the labels table: quality, then toxicity; and their wanted token shares.
TARGETS = {"good-clean": 0.70, "poor-clean": 0.22, "good-toxic": 0.05, "poor-toxic": 0.03}


def label_domain():
    return F.concat(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"), F.when(F.col("toxic") == 1, "-toxic").when(F.col("toxic") == 0, "-clean"))
