"""Word and shingle hashes of Arrow string columns, vectorised over the raw UTF-8 bytes.

A word's hash is a polynomial over its bytes (mod 2^64, random byte values),
read off prefix sums, then mixed; texts are handled in pieces of about
``PIECE`` bytes cut between words, so one very long text needs no more memory
than its own words do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: byte -> byte, A-Z lowered
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words are runs of anything but white space (space, \t \n \v \f \r)
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: words are runs of ASCII digits, ASCII letters and all non-ASCII characters
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers: list[np.ndarray] = []


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        out = []
        with np.errstate(over="ignore"):
            for base in (_BASE, _INV):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def flat_text(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    buf = arr.buffers()[2]
    return (np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)), off


def _hash_piece(c: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and hashes in bytes ``c``; words do not cross ``bounds`` (starts of texts)."""
    n = len(c)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = is_word[c]
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~w[:-1]
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~w[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = True
    last[inner - 1] = True
    starts, ends = np.flatnonzero(w & first), np.flatnonzero(w & last) + 1
    up, down = _pow_tables(n)
    with np.errstate(over="ignore"):
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(_BYTE[LOWER[c]] * up[:n], dtype=np.uint64, out=prefix[1:])
        return starts, mix64((prefix[ends] - prefix[starts]) * down[starts])


def text_groups(off: np.ndarray, piece: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most ``piece`` bytes together, or one longer text."""
    piece = piece or PIECE
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + piece, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(arr: pa.Array, is_word: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs [i, j) of texts: (i, j, words per text, 64-bit hashes of all their words in order)."""
    data, off = flat_text(arr)
    for i, j in text_groups(off):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= PIECE:
            rel = off[i:j] - lo
            starts, h = _hash_piece(data[lo:hi], rel, is_word)
            at = np.searchsorted(starts, np.append(rel, hi - lo))
            yield i, j, np.diff(at), h
            continue
        parts, p = [], lo                       # one long text: cut between words
        while p < hi:
            q = min(p + PIECE, hi)
            while q < hi and is_word[data[q]]:
                gap = np.flatnonzero(~is_word[data[q:q + 4096]])
                q = q + int(gap[0]) if len(gap) else min(q + 4096, hi)
                if len(gap):
                    break
            parts.append(_hash_piece(data[p:q], np.zeros(0, np.int64), is_word)[1])
            p = q
        h = np.concatenate(parts)
        yield i, j, np.array([len(h)]), h


def shingle_hashes(counts: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of ``k`` words; a text of fewer, but not none, gives its whole sequence."""
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.cumsum(counts) - counts
    mult = _U(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        docs, hashes = [], []
        if len(words) >= k:
            h = words[:len(words) - k + 1].copy()
            for s in range(1, k):
                h *= mult
                h += words[s:len(words) - k + 1 + s]
            ok = doc[:len(h)] == doc[k - 1:]
            docs.append(doc[:len(h)][ok])
            hashes.append(h[ok])
        for c in range(1, k):
            few = np.flatnonzero(counts == c)
            if len(few):
                h = np.full(len(few), c, np.uint64)
                for s in range(c):
                    h = h * mult + words[start[few] + s]
                docs.append(few)
                hashes.append(h)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), mix64(np.concatenate(hashes))
