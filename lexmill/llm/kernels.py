"""Vectorised text kernels shared by the Arrow-based operators.

A kernel works on the raw UTF-8 buffer of an Arrow string column, so a batch of
documents is split into words and hashed without a Python loop over words. Word
classes of all contracts here are unions of ASCII bytes, hence safe on UTF-8.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SLICE_BYTES = 1 << 19

#: Bytes that end a word: space and \t..\r; or, for letter-digit words, ASCII that is neither.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(_M1)
    x = (x ^ (x >> U(27))) * U(_M2)
    return x ^ (x >> U(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def bounded(batches, *columns: int, rows: int = 1024, size: int = 4 << 20):
    """Slices of the batches with at most so many rows and (but for a single longer one) bytes of text in the columns."""
    for whole in batches:
        lengths = sum(np.asarray(pc.fill_null(pc.binary_length(whole.column(c)), 0), np.int64) for c in columns)
        ends, at = np.cumsum(lengths), 0
        while at < whole.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = min(at + rows, max(at + 1, full), whole.num_rows)
            yield whole.slice(at, end - at)
            at = end


def sliced(kernel, answer: pa.DataType, *columns: pa.Array, **limits) -> pa.Array:
    """The answers of ``kernel`` to slices of the columns, bounded by the text of the first."""
    whole = pa.RecordBatch.from_arrays([*columns], names=[str(k) for k in range(len(columns))])
    return pa.concat_arrays([pa.array([], answer), *(kernel(*b.columns) for b in bounded([whole], 0, **limits))])


def word_spans(data: np.ndarray, off: np.ndarray, delim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words by document) of the words of documents ``data[off[d]:off[d + 1]]``."""
    word = ~delim[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    some = off[1:] > off[:-1]
    first, last = off[:-1][some], off[1:][some] - 1
    start[first] = word[first]
    end[last] = word[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.diff(np.searchsorted(s, off))


#: Low bytes of a 64-bit load that belong to a word with so many bytes left.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Longer words are hashed one by one.
_LONG = 64


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, two: bool) -> list[np.ndarray]:
    """A 64-bit hash, or two independent ones, of each ``data[s:e]``.

    Words are read eight bytes at a time and every step is a bijection of the bytes read, mixed
    with other constants in either hash, so words of up to eight bytes and one length never
    collide; words of over 64 bytes take the halves of a 128-bit BLAKE2 digest.
    """
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    n = e - s
    x = eight[s] & _LOW[np.minimum(n, 8)]
    size = n.astype(U)
    out = [mix(x ^ (size * U(_M2)))]
    if two:
        out.append(mix((x + U(_M1)) * U(_R) ^ (size * U(_M1))))
    more, at = np.flatnonzero((n > 8) & (n <= _LONG)), 8
    while len(more):
        x = eight[s[more] + at] & _LOW[np.minimum(n[more] - at, 8)]
        out[0][more] = mix((out[0][more] + U(_R)) ^ x)
        if two:
            out[1][more] = mix((out[1][more] ^ U(_M2)) * U(_R) + x)
        at += 8
        more = more[n[more] > at]
    for k in np.flatnonzero(n > _LONG).tolist():
        for h, half in zip(out, np.frombuffer(blake2b(data[s[k] : e[k]].tobytes(), digest_size=16).digest(), U)):
            h[k] = half
    return out


class Words:
    """Words of a batch: a 64-bit hash each (``two``: and a second one) in document order; ``woff[d]:woff[d+1]`` belong to document d."""

    def __init__(self, column, delim: np.ndarray = SPACES, lower: bool = False, two: bool = False):
        self.data, self.off = text_buffer(column)
        off, hs, counts = self.off, [], []
        n, d = len(off) - 1, 0
        while d < n:
            e = max(d + 1, int(np.searchsorted(off, off[d] + SLICE_BYTES, "right")) - 1)
            part = self.data[off[d] : off[e]]
            s, t, c = word_spans(part, off[d : e + 1] - off[d], delim) if len(part) else (np.zeros(0, np.int64),) * 2 + (np.zeros(e - d, np.int64),)
            hs.append(span_hashes(LOWER[part] if lower else part, s, t, two))
            counts.append(c)
            d = e
        each = [np.concatenate(x) for x in zip(*hs)] if hs else [np.zeros(0, U)] * (1 + two)
        self.hash, self.hash2 = each[0], each[-1] if two else None
        self.n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.woff = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)

    def doc(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def windows(self, k: int, seed: int = 1) -> np.ndarray:
        """Hash of the k words from each position (of the whole batch; see ``valid``); seeds 1 and 2 start from independent word hashes."""
        m = max(0, len(self.hash) - k + 1)
        acc, mult = np.zeros(m, U), U(_R * (2 * seed + 1) & (1 << 64) - 1 | 1)
        w = self.hash if seed == 1 else self.hash2
        for j in range(k):
            acc *= mult
            acc += w[j : j + m]
        return mix(acc)

    def valid(self, k: int) -> np.ndarray:
        """Positions from which k words lie in one document."""
        doc, m = self.doc(), max(0, len(self.hash) - k + 1)
        return np.flatnonzero(doc[:m] == doc[k - 1 : k - 1 + m]) if m else np.zeros(0, np.int64)


def exact_shingles(column, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of k words of each text, as numbers that are equal in the column exactly if the words are.

    Words are compared byte by byte (A-Z lower-cased): no hash decides. A text with fewer words has its whole sequence as one shingle.
    """
    data, off = text_buffer(column)
    data, off = LOWER[data[off[0] : off[-1]]], off - off[0]
    if not len(data):
        return [np.zeros(0, np.int64)] * (len(off) - 1)
    s, e, n = word_spans(data, off, SPACES)
    size = e - s
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    packed = data[~SPACES[data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    last = np.repeat(np.cumsum(n), n)  # one past each word's document
    code, many, at = ids, int(ids.max(initial=0)) + 1, np.arange(len(ids))
    for j in range(1, k):
        following = np.where(at + j < last, ids[np.minimum(at + j, len(ids) - 1)], 0)
        code = np.unique(code * many + following, return_inverse=True)[1]
    ends, out = np.cumsum(n), []
    for m, end in zip(n.tolist(), ends.tolist()):
        a = end - m
        out.append(np.unique(code[a : max(end - k, a) + 1]) if m else np.zeros(0, np.int64))
    return out


def planes(x: np.ndarray, delta: bool = False) -> bytes:
    """Integers as compressed byte planes; ``delta`` for ascending ones."""
    import zstandard

    x = np.ascontiguousarray(x)
    if delta and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def unplanes(b: bytes, dtype, delta: bool = False) -> np.ndarray:
    import zstandard

    raw, size = zstandard.ZstdDecompressor().decompress(b), np.dtype(dtype).itemsize
    x = np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(dtype).reshape(-1)
    return np.cumsum(x, dtype=dtype) if delta else x


def bits(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.packbits(x).tobytes())


def unbits(b: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8), count=n).astype(bool)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each hash; ascending hashes have ascending blocks."""
    return ((h >> U(16)) * U(blocks)) >> U(48)


def block_ends(h: np.ndarray, blocks: int) -> np.ndarray:
    """Cut points of sorted hashes by block."""
    return np.searchsorted(block_of(h, blocks), np.arange(blocks + 1, dtype=U))
