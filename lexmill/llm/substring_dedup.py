"""Substring deduplication: drop word windows that an earlier document already has.

Method: a count-min prefilter, then exact groups. Every chunk of documents makes a
sparse one-row count-min sketch of its windows (cells of 32 bits in each of ``blocks``
hash ranges, counts saturating at 2). The sketches are merged by block; a merged count
never falls below the true one, so a window whose estimate is 1 is unique and needs no
second look. Only windows estimated at 2 or more go through the second pass, which groups
them by 128-bit fingerprints and finds the smallest document id of each. The halves of a
fingerprint come from independent hashes of the words' bytes, so that two of 10**13 different
windows (100 TB) share one with a chance of 10**-12.

Defined cases: null text has no words; a document shorter than the window keeps all; a null
id counts as larger than any id; rows that share an id never remove each other's windows;
windows repeated inside one document alone stay; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import ID_MAX, back, chunk_count, chunked, exchange
from .kernels import U, Words, bits, block_ends, planes, unbits, unplanes

_SENT = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_SENT.names, r)) for r in rows], _SENT)


def _windows(docs: pa.Table, window: int, two: bool = True):
    """Words, valid starts, first fingerprints, document ids (null as ID_MAX)."""
    w = Words(docs["text"], two=two)
    at = w.valid(window)
    ids = docs["doc_id"].combine_chunks().fill_null(ID_MAX).to_numpy(zero_copy_only=False)
    return w, at, w.windows(window)[at] if len(at) else np.zeros(0, U), ids


def _cells(h: np.ndarray, blocks: int) -> np.ndarray:
    """block << 32 | cell, ascending with the hash."""
    x = (h >> U(16)) * U(blocks)
    return (x >> U(48)) << U(32) | (x >> U(16)) & U(0xFFFFFFFF)


def _estimated(h, blocks, answers: pa.Table) -> np.ndarray:
    """Which windows have a merged sketch count of 2 or more."""
    cells, inverse = np.unique(_cells(h, blocks), return_inverse=True)
    cut = np.searchsorted(cells, np.arange(blocks + 1, dtype=U) << U(32))
    twice = np.zeros(len(cells), bool)
    for kind, b, data in zip(*(answers[c].to_pylist() for c in ("kind", "block", "data"))):
        if kind == 0:
            twice[cut[b] : cut[b + 1]] = unbits(data, cut[b + 1] - cut[b])
    return twice[inverse]


def _groups(w: Words, at, h, ids, likely, window):
    """Distinct estimated windows: order, group number by position, (h1, h2, smallest id) by group."""
    at, h = at[likely], h[likely]
    h2 = w.windows(window, 2)[at] if len(at) else np.zeros(0, U)
    doc = ids[w.doc()[at]]
    order = np.lexsort((doc, h2, h))
    a, b = h[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    return at, doc, group, h[first], h2[first], doc[first]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, chunks: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    n = chunks or chunk_count(docs, text_col)
    source = chunked(docs, id_col, text_col, n)

    def sketch(t: pa.Table) -> pa.Table:
        _, _, h, _ = _windows(t, window, False)
        cells, count = np.unique(_cells(h, n), return_counts=True)
        cut = np.searchsorted(cells, np.arange(n + 1, dtype=U) << U(32))
        chunk, low, many = t["chunk"][0].as_py(), cells.astype(np.uint32), count > 1
        return _rows([(chunk, k, b, d) for b in range(n) if cut[b] < cut[b + 1] for k, d in ((0, planes(low[cut[b] : cut[b + 1]], True)), (1, bits(many[cut[b] : cut[b + 1]])))])

    def merge(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("chunk", "kind", "data"))), key=lambda r: r[:2])
        lists = {c: unplanes(d, np.uint32, True) for c, k, d in rows if k == 0}
        many = {c: unbits(d, len(lists[c])) for c, k, d in rows if k == 1}
        cells = np.sort(np.concatenate([*lists.values(), *(lists[c][many[c]] for c in lists)]))
        twice = np.unique(cells[1:][cells[1:] == cells[:-1]])
        block, out = t["block"][0].as_py(), []
        for c, x in lists.items():
            i = np.searchsorted(twice, x)
            out.append((c, 0, block, bits((i < len(twice)) & (twice[np.minimum(i, len(twice) - 1)] == x) if len(twice) else np.zeros(len(x), bool))))
        return _rows(out)

    def suspects(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return _rows([])
        w, at, h, ids = _windows(docs, window)
        _, _, _, h1, h2, doc = _groups(w, at, h, ids, _estimated(h, n, answers), window)
        cut, chunk = block_ends(h1, n), docs["chunk"][0].as_py()
        return _rows([(chunk, k, b, planes(x[cut[b] : cut[b + 1]], k == 0)) for b in range(n) if cut[b] < cut[b + 1] for k, x in enumerate((h1, h2, doc))])

    def exact(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("chunk", "kind", "data"))), key=lambda r: r[:2])
        parts = [(c, *(unplanes(d, (U, U, np.int64)[k], k == 0) for _, k, d in g)) for c, g in itertools.groupby(rows, key=lambda r: r[0])]
        h1, h2, doc = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        order = np.lexsort((doc, h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        smallest = np.empty(len(a), np.int64)
        smallest[order] = doc[order][new][np.cumsum(new) - 1]
        later, block, out, p = doc > smallest, t["block"][0].as_py(), [], 0
        for c, x, *_ in parts:
            out.append((c, 1, block, bits(later[p : p + len(x)])))
            p += len(x)
        return _rows(out)

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
        if not len(docs):
            return schema.empty_table()
        w, at, h, ids = _windows(docs, window)
        at, doc, group, h1, _, smallest = _groups(w, at, h, ids, _estimated(h, n, answers), window)
        cut, later = block_ends(h1, n), np.zeros(len(h1), bool)
        for kind, b, data in zip(*(answers[c].to_pylist() for c in ("kind", "block", "data"))):
            if kind == 1:
                later[cut[b] : cut[b + 1]] = unbits(data, cut[b + 1] - cut[b])
        at = at[later[group] | (doc > smallest[group])]
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[w.woff[1:]] - before[w.woff[:-1]]
        keep, kept, raw = ~gone, [], w.data
        for d in range(len(docs)):
            words = raw[w.off[d] : w.off[d + 1]].tobytes().split()
            kept.append(b" ".join(itertools.compress(words, keep[w.woff[d] : w.woff[d + 1]].tolist()) if removed[d] else words).decode())
        return pa.table([docs["doc_id"].combine_chunks(), pa.array(w.n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    schema = "chunk int, kind int, block int, data binary"
    estimates = exchange(source.groupBy("chunk").applyInArrow(sketch, schema), merge)
    found = exchange(back(source, estimates, suspects, schema), exact)
    return back(source, estimates.unionByName(found), remove, "doc_id long, n_words long, n_removed long, kept_text string")
