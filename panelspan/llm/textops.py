"""Vectorised word hashing over Arrow string columns.

Texts are handled as one UTF-8 byte buffer with document offsets. A word's hash
is a polynomial over its bytes taken from prefix sums, so whole batches hash in
a few numpy passes; no Python loop runs over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_M = U64(0x9E3779B97F4A7C15 | 1)
_M_INV = U64(pow(int(_M), -1, 1 << 64))
_PIECE = 1 << 21

#: Bytes that end a word.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes other than digits and small letters (applied after lower-casing).
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) <= n:
        size = max(n + 1, _PIECE // 8)
        for i, m in enumerate((_M, _M_INV)):
            p = np.full(size, m, U64)
            p[0] = 1
            _POW[i] = np.cumprod(p)
    return _POW[0], _POW[1]


def string_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some documents: byte spans, hashes, and where each document's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document, with one more entry at the end

    def of_word(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_spans(buf: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~ends[buf]
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(buf))]
    before[edge] = False
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def spans_hashes(buf: np.ndarray, start: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of byte spans from start to each of ends (all sorted), piece by piece so that memory stays bounded."""
    outs = [np.empty(len(start), U64) for _ in ends]
    far = ends[0]
    for e in ends[1:]:
        far = np.maximum(far, e)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(far, base + _PIECE, "right")))
        top = int(far[j - 1])
        pow_, inv = _powers(top - base)
        sums = np.empty(top - base + 1, U64)
        sums[0] = 0
        np.cumsum(_BYTE[buf[base:top]] * pow_[: top - base], out=sums[1:])
        s = start[i:j] - base
        head, back = sums[s], inv[s]
        for out, end in zip(outs, ends, strict=True):
            e = end[i:j] - base
            out[i:j] = mix((sums[e] - head) * back + (e - s).astype(U64) * U64(0xA0761D6478BD642F))
        i = j
    return outs


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans_hashes(buf, start, [end])[0]


def words(buf: np.ndarray, offsets: np.ndarray, ends: np.ndarray = BLANKS, lower: bool = True) -> Words:
    if lower:
        buf = LOWER[buf]
    start, end = word_spans(buf, offsets, ends)
    return Words(start, end, span_hashes(buf, start, end), np.searchsorted(start, offsets))


_COEF = mix(np.arange(1, 65, dtype=U64) * U64(0xE7037ED1A0B428DB)) | U64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, document borders ignored; n at most 64."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    total = np.full(size, n * 0x8EBC6AF09C88C6E3 % (1 << 64), U64)
    for k in range(n):
        total += hashes[k : k + size] * _COEF[k]
    return mix(total)


def chunks(buf: np.ndarray, offsets: np.ndarray, limit: int = 1 << 21):
    """(first, last+1, bytes, offsets) of runs of whole documents of about limit bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def document_grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each document's n-word runs; a document of fewer words, but not none, has one of them all."""
    count = np.diff(w.first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(first[-1], U64)
    g = grams(w.hash, n)
    long = count >= n
    if long.any():
        idx = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], made)
        full = np.repeat(long, made)
        out[full] = g[idx[full]]
    for d in np.flatnonzero((count > 0) & ~long):
        h = w.hash[w.first[d] : w.first[d + 1]]
        out[first[d]] = grams(h, len(h))[0]
    return out, first
