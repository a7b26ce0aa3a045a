"""MinHash near-duplicate groups: one-permutation hashing, banded buckets, star-shaped candidates.

Method. A document's shingles are hashed once; the hash range is cut into ``bands * rows``
bins and the least hash of each bin is the signature. Empty bins are filled by optimal
densification: bin i asks the bins of a fixed random sequence for i until one is filled.
Equal shingle sets form one class, found by a 128-bit digest of 128-bit shingle hashes before
anything else, so copies cost one row each. The classes' bands form buckets; each bucket's least class is its centre
and the other classes are compared to the centre only (a star): 16 bits of each shingle's hash bound the common shingles from above, which
rules out most pairs that are no links; the rest are confirmed on their full sets of words, which
are compared byte by byte.

Links that the stars don't show are found by joining whole buckets. A bucket whose classes are all
in one component is done. The classes of any other meet in one task with their 16-bit hashes, in
tiles if they have more than ``TILE`` bytes, and every two of different components are counted:
the hashes that many have in common by a product of 0/1 matrices, the rest only for pairs that
this leaves possible. A link within the components found so far isn't wanted, so a task gives a
spanning forest, at most one pair per class, and only these are met and confirmed on their words.
A bucket with a pair that isn't confirmed is joined again without it. So no bucket is capped and
none of its links between components is lost, while neither texts nor hashes are sent by the pair.

Defined cases: null and empty texts have no shingles and link with nothing; with fewer words
than a shingle the whole sequence is the only one; a null id is kept as null, and a group of
null ids only has a null component; rows that repeat an id are grouped by their own texts;
ties go to the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .exchange import name
from .kernels import SPACES, U, Words, bounded, exact_shingles, mix
from .scratch import discard, scratch


@lru_cache(4)
def _bins(k: int):
    """Lower ends of the bins, and the bins that each empty bin asks in turn."""
    edges = np.array([i * (1 << 64) // k for i in range(k)], U)
    asks = mix(np.arange(k * 2048, dtype=U) + U(77)) % U(k)
    return edges, asks.reshape(k, 2048).astype(np.int64)


def shingle_sets(column, shingle: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text: two independent 64-bit hashes, sorted by the first."""
    w = Words(column, SPACES, True, two=True)
    full, second, out = w.windows(shingle), w.windows(shingle, 2), []
    for d, n in enumerate(w.n.tolist()):
        a = w.woff[d]
        if n >= shingle:
            h, at = np.unique(full[a : a + n - shingle + 1], return_index=True)
            out.append((h, second[a + at]))
        elif n:
            out.append(tuple(_whole(x[a : a + n]) for x in (w.hash, w.hash2)))
        else:
            out.append((np.zeros(0, U), np.zeros(0, U)))
    return out


def _whole(words: np.ndarray) -> np.ndarray:
    h = U(len(words))
    for x in words:
        h = mix(np.array([h], U) * U(31) + x)[0]
    return np.array([h], U)


def digest(s: tuple[np.ndarray, np.ndarray]) -> bytes:
    """128 bits of a set of shingles with 128 bits each."""
    return blake2b(s[0].tobytes() + s[1].tobytes(), digest_size=16).digest()


def signature(s: np.ndarray, k: int) -> np.ndarray:
    """One-permutation MinHash of a sorted set, optimally densified."""
    edges, asks = _bins(k)
    at = np.searchsorted(s, edges)
    end = np.append(at[1:], len(s))
    filled = at < end
    sig = s[np.minimum(at, len(s) - 1)]
    empty = np.flatnonzero(~filled)
    for width in (64, 2048):
        if not len(empty):
            return sig
        found = filled[asks[empty, :width]]
        first = found.argmax(1)
        got = found[np.arange(len(empty)), first]
        sig[empty[got]] = sig[asks[empty[got], first[got]]]
        empty = empty[~got]
    if len(empty):
        have = np.flatnonzero(filled)
        sig[empty] = sig[have[np.searchsorted(have, empty) % len(have)]]
    return sig


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tie, n, cls, bands, short): hash of the text, set size, set digest (null for no shingles), band hashes, 16 bits of each shingle hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64())), ("short", pa.binary())])
    salt = mix(np.arange(bands, dtype=U) + U(5))

    def kernel(batches):
        for batch in bounded(batches, 1):
            sets, cls, out, short = shingle_sets(batch.column(1), shingle), [], [], []
            for s in sets:
                if len(s[0]):
                    acc = salt.copy()
                    for col in signature(s[0], bands * rows).reshape(bands, rows).T:
                        acc = mix(acc * U(31) + col)
                    cls.append(digest(s))
                    out.append(acc.view(np.int64))
                    short.append((s[0] >> U(48)).astype("<u2").tobytes())
                else:
                    cls.append(None)
                    out.append(None)
                    short.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s[0]) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(out, pa.list_(pa.int64())), pa.array(short, pa.binary())], schema=schema)

    return docs.select(name(id_col).cast("long").alias("doc_id"), name(text_col).cast("string").alias("text"), F.xxhash64(name(text_col)).alias("tie")).mapInArrow(kernel, "doc_id long, tie long, n long, cls binary, bands array<long>, short binary")


#: Pairs of one centre that meet its value in one task; classes whose values are looked up by broadcast; bytes of short hashes in a tile.
PAIRS, BROADCAST_CLASSES, TILE = 256, 1_000_000, 2 << 20


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("m").alias("cls")).union(pairs.select(F.col("c").alias("cls"))).distinct()


def _values(used: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """(cls, v) of the distinct classes ``used``: the value of each class's first row in ``source`` (doc_id, tie, v)."""
    used = scratch(used.join(classes.select("cls", "min_doc", F.col("tie").alias("min_tie")), "cls"), "used")
    if used.count() <= BROADCAST_CLASSES:
        used = F.broadcast(used)
    # equal rows of one class give equal values; one is enough
    return source.join(used, F.col("min_doc").eqNullSafe(F.col("doc_id")) & (F.col("tie") == F.col("min_tie"))).select("cls", "v").dropDuplicates(["cls"])


def _met(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(m, c, v_m, v_c): the values (cls, v) of both ends. The pairs of one centre are spread over copies of its value."""
    centres = pairs.groupBy("c").agg(F.ceil(F.count("*") / PAIRS).cast("long").alias("copies"))
    spread = pairs.join(centres, "c").select("m", "c", F.pmod(F.xxhash64("m"), "copies").alias("copy"))
    of_c = values.withColumnRenamed("cls", "c").join(centres, "c").select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("v").alias("v_c"))
    return spread.join(values.select(F.col("cls").alias("m"), F.col("v").alias("v_m")), "m").join(of_c, ["c", "copy"]).select("m", "c", "v_m", "v_c")


_PAIR = pa.schema([("m", pa.int64()), ("c", pa.int64())])


def _possible(pairs: DataFrame, classes: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """(m, c) of the pairs that may be links: equal short hashes bound the common shingles from above, so no link is lost."""

    def most(x: bytes, y: bytes) -> int:
        (a, i), (b, j) = (np.unique(np.frombuffer(v, "<u2"), return_counts=True) for v in (x, y))
        _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return int(np.minimum(i[at], j[to]).sum())

    def kernel(batches):
        for b in bounded(batches, 2, 3):
            keep = [most(x, y) * (100 + percent) >= percent * (len(x) + len(y)) // 2 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=_PAIR).filter(pa.array(keep, pa.bool_()))

    return _met(pairs, _values(_ends(pairs), classes, sig.select("doc_id", "tie", F.col("short").alias("v")))).mapInArrow(kernel, "m long, c long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(m, c) of the pairs that are links, on full sets of the words of their texts."""
    text = docs.select(name(id_col).cast("long").alias("doc_id"), F.xxhash64(name(text_col)).alias("tie"), name(text_col).cast("string").alias("v"))

    def kernel(batches):
        for b in bounded(batches, 2, 3, rows=256):
            sets = exact_shingles(pa.concat_arrays([b.column(2), b.column(3)]), shingle)
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets, sets[b.num_rows :])]
            keep = [k * 100 >= (len(x) + len(y) - k) * percent for k, x, y in zip(common, sets, sets[b.num_rows :])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=_PAIR).filter(pa.array(keep, pa.bool_()))

    return _met(pairs, _values(_ends(pairs), classes, text)).mapInArrow(kernel, "m long, c long")


class _Tokens:
    """Multisets of 16-bit hashes as sets of numbers: the hash and which of its equals it is."""

    def __init__(self, shorts: list[bytes]):
        self.n = np.array([len(v) // 2 for v in shorts], np.int64)
        self.at = np.cumsum(self.n) - self.n
        x = np.frombuffer(b"".join(shorts), "<u2")  # ascending in each set
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        new[self.at[self.n > 0]] = True
        first = np.flatnonzero(new)
        self.token = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        if self.token.max(initial=0) < 1 << 15:
            self.token = self.token.astype(np.int32)
        self.token <<= 16
        self.token += x
        self.flag = np.zeros(int(self.token.max(initial=0)) + 1, bool)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Tokens of the (not empty) sets, one set after the other."""
        n = self.n[rows]
        return self.token[np.repeat(self.at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def common(self, x: int, rows: np.ndarray) -> np.ndarray:
        """How many tokens set x has in common with each of the sets."""
        own, out, step = self.token[self.at[x] : self.at[x] + self.n[x]], [], max(1, (1 << 20) // int(self.n[rows].max(initial=1)))
        self.flag[own] = True
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            out.append(np.add.reduceat(self.flag[self.of(part)], np.cumsum(self.n[part]) - self.n[part], dtype=np.int64))
        self.flag[own] = False
        return np.concatenate(out)


def _bounds(t: _Tokens, rows: np.ndarray, outside: int, percent: int):
    """Of each of the first ``outside`` rows in turn: which of the rows after it it may be linked with. Common tokens are bounded from above."""
    many = len(rows)
    if outside * many < 256:
        for k in range(outside):
            yield np.ones(many - k - 1, bool)
        return
    tokens, n = t.of(rows), t.n[rows]
    ids, count = np.unique(tokens, return_counts=True)
    column = np.searchsorted(ids, tokens).astype(np.int32)
    dense = count >= max(2, many / 4)
    number, owner = np.cumsum(dense) - 1, np.repeat(np.arange(many, dtype=np.int32), n)
    x = np.zeros((many, int(dense.sum())), np.float32)
    kept = dense[column]
    x[owner[kept], number[column[kept]]] = 1
    # tokens that are neither dense nor one row's own
    other = np.bincount(owner[~kept & (count[column] > 1)], minlength=many).astype(np.float32)
    need = (n * (percent / (100 + percent))).astype(np.float32)
    step = max(1, (1 << 21) // many)
    for k in range(0, outside, step):
        end = min(k + step, outside)
        most = x[k:end] @ x[k:].T
        most += np.minimum(other[k:end, None], other[k:])
        may = most * np.float32(1.00001) + 1 >= need[k:end, None] + need[k:]  # with room for rounding
        for r in range(end - k):
            yield may[r, r + 1 :]


def forest(t: _Tokens, rows: np.ndarray, root: np.ndarray, percent: int, tile: np.ndarray | None = None, bad: dict[int, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of rows of different roots that may be links and, with the roots, connect all that such pairs connect.

    ``tile``: only rows of different tiles are paired. ``bad``: by row, those that it isn't paired with.
    """
    _, label, count = np.unique(root[rows], return_inverse=True, return_counts=True)
    order = np.argsort(label == count.argmax(), kind="stable")  # pairs have an end outside the most frequent root
    rows, label, out = rows[order], label[order], []
    outside = len(rows) - int(count.max())
    for k, may in enumerate(_bounds(t, rows, outside, percent)):
        may = may & (label[k + 1 :] != label[k])
        if tile is not None:
            may &= tile[rows[k + 1 :]] != tile[rows[k]]
        if bad and rows[k] in bad:
            may &= ~np.isin(rows[k + 1 :], bad[rows[k]])
        left, some = np.flatnonzero(may) + k + 1, 0
        while len(left):
            # one row of each root; as long as that doesn't settle them, more and more of them
            tried = np.sort(np.unique(label[left], return_index=True)[1]) if not some else np.arange(min(some, len(left)))
            some = max(16, some * 4)
            test = left[tried]
            good = t.common(rows[k], rows[test]) * (100 + percent) >= percent * (t.n[rows[k]] + t.n[rows[test]])
            for y in test[good]:
                if label[y] != label[k]:
                    out.append((int(rows[k]), int(rows[y])))
                    label[label == label[y]] = label[k]
            left = np.delete(left, tried)
            left = left[label[left] != label[k]]
    return out


_FOUND = pa.schema([("h", pa.int64()), ("m", pa.int64()), ("c", pa.int64())])


def _joined(rest: DataFrame, failed: DataFrame | None, classes: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """(h, m, c): pairs of classes of different roots in a bucket of ``rest`` (h, cls, n, root) that may be links, a forest per bucket and tile pair; none of ``failed`` (m, c)."""
    values = _values(rest.select("cls").distinct(), classes, sig.select("doc_id", "tie", F.col("short").alias("v")))
    sizes = rest.groupBy("h").agg(F.ceil(F.sum(F.col("n").cast("long")) * 2 / F.lit(TILE)).cast("int").alias("tiles"))
    groups = int(rest.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) * 2 // TILE + 1
    r = rest.join(sizes, "h").join(values, "cls")
    if failed is None:
        r = r.withColumn("bad", F.array().cast("array<bigint>"))
    else:
        both = failed.union(failed.select("c", "m")).groupBy(F.col("m").alias("cls")).agg(F.collect_set("c").alias("bad"))
        r = r.join(both, "cls", "left")
    r = r.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # small buckets share a task
    r = r.select(F.when(F.col("tiles") == 1, F.pmod("h", F.lit(groups))).otherwise(F.col("h")).alias("g"), F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "h", "cls", "root", "tile", "v", "bad")

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("cls", "ascending")])
        h, cls, root, tile = (table.column(c).to_numpy() for c in ("h", "cls", "root", "tile"))
        across = tile if table.num_rows and table.column("a")[0] != table.column("b")[0] else None
        v, bads, out = table.column("v"), table.column("bad"), []
        for at, end in zip(starts := np.flatnonzero(np.append(True, h[1:] != h[:-1])), np.append(starts[1:], len(h))):
            ids, no = cls[at:end], bads[at:end].to_pylist()
            bad = {k: np.flatnonzero(np.isin(ids, x)) for k, x in enumerate(no) if x}
            found = forest(_Tokens(v[at:end].to_pylist()), np.arange(end - at), root[at:end], percent, across if across is None else across[at:end], bad)
            out += [(h[at], max(ids[x], ids[y]), min(ids[x], ids[y])) for x, y in found]
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], schema=_FOUND)

    return r.groupBy("g", "a", "b").applyInArrow(kernel, "h long, m long, c long")


def _rooted(rows: DataFrame, roots: DataFrame, column: str, root: str) -> DataFrame:
    """``rows`` with the root of the class in ``column``; a class without links is its own."""
    r = roots.select(F.col("node").alias(column), F.col("root").alias(root))
    return rows.join(r, column, "left").withColumn(root, F.coalesce(root, column))


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, tie (hash of its text), n_shingles, component_id, kept, n_links (links
    shown to other classes), group (one value per component, null without shingles)."""
    sig = scratch(signatures(docs, id_col, text_col, shingle, bands, rows), "sig")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first")
    classes = sig.where("cls is not null").groupBy("cls").agg(first, F.first("n").cast("int").alias("n"), F.first("bands").alias("bands"))
    # numbers are unique, and fixed once they are written down
    classes = scratch(classes.select(F.col("cls").alias("digest"), F.monotonically_increasing_id().alias("cls"), F.col("first.doc_id").alias("min_doc"), "first.tie", "n", "bands"), "cls")
    every = classes.select("cls", "n", F.explode("bands").alias("h"))
    centre = every.groupBy("h").agg(F.min("cls").alias("c"), F.count("*").alias("k")).where("k > 1").select("h", "c")
    # each member of a bucket beside its centre
    starred = scratch(every.join(centre, "h").where("cls <> c").select("h", "cls", "n", "c"), "star")
    met = starred.select(F.col("cls").alias("m"), "n", "c").distinct()
    met = scratch(met.join(classes.select(F.col("cls").alias("c"), F.col("n").alias("nc")), "c"), "met")
    pairs = met.where(f"least(n, nc) * 100L >= greatest(n, nc) * {percent}L").select(F.greatest("m", "c").alias("m"), F.least("m", "c").alias("c")).distinct()
    possible = scratch(_possible(scratch(pairs, "pairs"), classes, sig, percent), "possible")
    confirmed = lambda p: scratch(_verified(p, classes, docs, id_col, text_col, shingle, percent), "links")
    links = confirmed(possible).select(F.col("m").alias("a"), F.col("c").alias("b"))
    discard(possible)
    roots = components(links)

    def unsettled(part: DataFrame) -> DataFrame:
        """(h, cls, n, root) of the buckets with classes of several components."""
        part = _rooted(part, roots, "cls", "root")
        several = part.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
        return scratch(part.join(several, "h", "left_semi").select("h", "cls", "n", "root"), "rest")

    # only buckets with a member that isn't yet in its centre's component go on, without the centre
    apart = _rooted(_rooted(met.select(F.col("m").alias("cls"), "c"), roots, "cls", "root"), roots, "c", "rc").where("root <> rc").select("cls", "c")
    open_ = starred.join(apart, ["cls", "c"], "left_semi").select("h").distinct()
    rest, failed = unsettled(starred.join(open_, "h", "left_semi").select("h", "cls", "n")), None
    discard(starred)
    while not rest.isEmpty():
        found = scratch(_joined(rest, failed, classes, sig, percent), "found")
        if found.isEmpty():
            break
        new = confirmed(scratch(found.select("m", "c").distinct(), "pairs"))
        wrong = scratch(found.join(new, ["m", "c"], "left_anti"), "wrong")
        new = new.select(F.col("m").alias("a"), F.col("c").alias("b"))
        links, roots = links.union(new), components(new.union(roots.select("node", "root")))
        if wrong.isEmpty():
            break
        failed = wrong.select("m", "c").distinct() if failed is None else failed.union(wrong.select("m", "c")).distinct()
        old, rest = rest, unsettled(rest.join(wrong.select("h").distinct(), "h", "left_semi").select("h", "cls", "n"))
        discard(old)
    ends = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
    known = _rooted(classes.select("digest", "cls", "min_doc"), roots, "cls", "root")
    least = known.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    label = known.join(least, "root").join(ends, "cls", "left").select(F.col("digest").alias("cls"), F.col("root").alias("group"), "component_id", "n_links")
    out = sig.select("doc_id", "tie", F.col("n").alias("n_shingles"), "cls").join(label, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tie", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "group")
