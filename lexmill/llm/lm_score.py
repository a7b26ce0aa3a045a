"""Stupid-backoff language-model scores of every document under counts of the whole collection.

Method: n-gram count tables partitioned by hash, joined to the documents' n-grams and summed
per document. A table row is a block of hashes with its counts; a chunk's distinct n-grams
are its side of the join. Both sides are packed: a plain row per distinct n-gram of a document
shuffles several times the input (figures in the README). With order 3 a word scores c(uvw)/c(uv) if uvw occurs (it does, as
all documents are counted, unless ``leave_one_out``), else backoff * c(vw)/c(v), else
backoff**2 * c(w)/N. With ``leave_one_out`` a document's own n-grams are taken from the
counts first, so that the score says how usual it is for the rest of the collection; a word that
occurs nowhere else scores as half an occurrence.

Defined cases: null, empty and all-space texts have n_words 0 and null scores; n-grams don't
cross documents, a null id stays null and its row is scored like any other, and counts are of rows, so repeated rows count as often as they occur; the
empty table gives an empty result. n-grams are identified by 60-bit hashes, of which
half a byte less travels than of 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import back, chunk_count, chunked, exchange
from .kernels import SPACES, U, Words, block_ends, planes, unplanes
from .substring_dedup import _rows

_KEEP = ~U(15)


def _grams(w: Words, k: int):
    """Starts and hashes of the n-grams of length k."""
    at = w.valid(k)
    return at, w.windows(k)[at] & _KEEP if len(at) else np.zeros(0, U)


def _own(w: Words, at, i, parts: int = 8):
    """For each n-gram place: how often its n-gram occurs in that document; an eighth of the documents at a time."""
    doc, out = w.doc()[at], np.empty(len(at), np.int32)
    cuts = np.searchsorted(doc, np.linspace(0, len(w.n), parts + 1).astype(np.int64))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            key = doc[a:b] << 40 | i[a:b]
            order = np.argsort(key)
            new = np.flatnonzero(np.diff(key[order], prepend=-1))
            size = np.diff(new, append=b - a)
            out[a + order] = np.repeat(size, size)
    return out


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, backoff: float = 0.4, leave_one_out: bool = True, chunks: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, log_score (sum of natural logs), mean_log_score."""
    n = chunks or chunk_count(docs, text_col)
    source = chunked(docs, id_col, text_col, n)

    def count(t: pa.Table) -> pa.Table:
        w, chunk, rows = Words(t["text"], SPACES, True), t["chunk"][0].as_py(), []
        for k in range(order):
            u, c = np.unique(_grams(w, k + 1)[1], return_counts=True)
            cut = block_ends(u, n)
            rows += [(chunk, 2 * k + j, b, planes(x[cut[b] : cut[b + 1]], not j)) for b in range(n) if cut[b] < cut[b + 1] for j, x in ((0, u), (1, c.astype(np.int64)))]
        return _rows([*rows, (chunk, -1, 0, planes(np.array([len(w.hash)])))])

    def table(t: pa.Table) -> pa.Table:
        got = {(c, k): d for c, k, d in zip(*(t[x].to_pylist() for x in ("chunk", "kind", "data")))}
        block, out = t["block"][0].as_py(), []
        if total := [unplanes(d, np.int64)[0] for (_, k), d in got.items() if k == -1]:
            out += [(c, -1, block, planes(np.array([sum(total)]))) for c in {c for c, k in got if k == -1}]
        for k in range(order):
            parts = [(c, unplanes(got[c, 2 * k], U, True), unplanes(got[c, 2 * k + 1], np.int64)) for c in sorted({c for c, j in got if j == 2 * k})]
            if parts:
                u, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
                total = np.zeros(len(u), np.int64)
                np.add.at(total, inverse, np.concatenate([p[2] for p in parts]))
                at = 0
                for c, x, _ in parts:
                    out.append((c, k, block, planes(total[inverse[at : at + len(x)]])))
                    at += len(x)
        return _rows(out)

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])
        if not len(docs):
            return schema.empty_table()
        w, counts, total, got = Words(docs["text"], SPACES, True), [], 0, {}
        for k, b, d in zip(*(answers[x].to_pylist() for x in ("kind", "block", "data"))):
            if k == -1:
                total = int(unplanes(d, np.int64)[0])
            else:
                got[k, b] = d
        for k in range(order):  # one length at a time bounds the memory
            at, h = _grams(w, k + 1)
            u, i = np.unique(h, return_inverse=True)
            del h
            cut, totals = block_ends(u, n), np.zeros(len(u), np.int64)
            for b in range(n):
                if (k, b) in got:
                    totals[cut[b] : cut[b + 1]] = unplanes(got[k, b], np.int64)
            full = np.zeros(len(w.hash) + 1, np.int64)
            full[at] = totals[i] - (_own(w, at, i) if leave_one_out else 0)
            counts.append(full)
            del at, u, i, totals
        m = len(w.hash)
        own = np.repeat(w.n, w.n) if leave_one_out else 0
        p = np.maximum(counts[0][:m], 0.5 if leave_one_out else 0) / np.maximum(total - own, 1)
        place = np.arange(m) - np.repeat(w.woff[:-1], w.n)
        for k in range(1, order):
            joint, context = np.zeros(m, np.int64), np.ones(m, np.int64)
            joint[k:] = counts[k][: max(0, m - k)]
            context[k:] = counts[k - 1][: max(0, m - k)]
            seen = (place >= k) & (joint > 0)
            p = np.where(seen, joint / np.maximum(context, 1), np.where(place >= k, backoff * p, p))
        sums = np.zeros(len(w.n))
        if m:
            sums[w.n > 0] = np.add.reduceat(np.log(p), w.woff[:-1][w.n > 0])
        none = w.n == 0
        return pa.table([docs["doc_id"].combine_chunks(), pa.array(w.n, pa.int64()), pa.array(sums, mask=none), pa.array(sums / np.maximum(w.n, 1), mask=none)], schema=schema)

    sent = source.groupBy("chunk").applyInArrow(count, "chunk int, kind int, block int, data binary")
    return back(source, exchange(sent, table), score, "doc_id long, n_words long, log_score double, mean_log_score double")
