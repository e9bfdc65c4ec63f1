"""Word shingles as 64-bit hashes, computed for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)
# a fixed odd base, and its inverse modulo 2^64, for the rolling word hash
BASE = 0xD1342543DE82EF95
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def runs_of_documents(off: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    out, start, n = [], 0, len(off) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        out.append((start, min(stop, n)))
        start = out[-1][1]
    return out


def in_runs(f, raw: np.ndarray, off: np.ndarray, *args) -> tuple[np.ndarray, np.ndarray]:
    """``f`` over ranges of documents, so that its arrays stay small; results one after another."""
    parts = [f(raw[off[a]:off[b]], off[a:b + 1] - off[a], *args) for a, b in runs_of_documents(off)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of every document, A-Z lower-cased, in order,
    and the number of words per document. ``raw``/``off``: the documents' bytes and offsets."""
    return in_runs(_word_hashes, raw, off)


def _word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_docs = len(off) - 1
    upper = (raw >= 65) & (raw <= 90)
    low = raw + (upper * np.uint8(32))
    in_word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    before = np.empty(len(low) + 1, dtype=bool)
    before[0] = False
    before[1:] = in_word
    before[off[:-1]] = False  # a document's first byte follows nothing
    starts = np.flatnonzero(in_word & ~before[:-1])
    after = np.empty(len(low) + 1, dtype=bool)
    after[:-1] = in_word
    after[-1] = False
    after[off] = False
    ends = np.flatnonzero(in_word & ~after[1:]) + 1
    counts = np.searchsorted(starts, off[1:]) - np.searchsorted(starts, off[:-1])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    total = np.empty(len(low) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(low)), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(BASE_INV, len(low))[starts]
    return mix(h ^ mix((ends - starts).astype(np.uint64) * MULT)), counts


def shingle_hashes(raw: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of every document as sorted 64-bit hashes, one after another, and
    their number per document. A document with fewer words has its whole sequence as one shingle;
    without words it has none."""
    return in_runs(_shingle_hashes, raw, off, k)


def _shingle_hashes(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = _word_hashes(raw, off)
    n_docs = len(counts)
    n_sh = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    doc = np.repeat(np.arange(n_docs), n_sh)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh) + first[doc]
    size = np.minimum(counts, k)[doc]
    h = mix(size.astype(np.uint64) * MULT)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        h = np.where(j < size, mix(h * MULT + padded[at + j]), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=n_docs)
