"""Byte-level word splitting and 64-bit word hashes over Arrow text columns.

Both word classes the operators use treat every byte >= 0x80 as a word byte,
so splitting the UTF-8 bytes equals splitting the characters, and one numpy
pass over a batch's buffer replaces a per-document regular expression.

A word's hash is a polynomial in an odd base modulo 2**64, taken from prefix
sums (the base is invertible, so a word's value does not depend on where it
stands), followed by a bit mixer.  Long inputs are hashed in pieces of
``PIECE`` bytes, so memory does not grow with one text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32

#: words of ``[^\x20\x09-\x0D]+``
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow_tables(n: int):
    n = max(n, PIECE)
    if n not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(n, base, dtype=_U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=_U))
        _powers[n] = tuple(out)
    return _powers[n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + texts.offset)[texts.offset:]
    if data is None or n == 0:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def words(texts: pa.Array, word_bytes: np.ndarray):
    """All words of a batch: (hash of each word, words before each text).

    The second array has one entry per text plus one; text *i* owns the
    words ``first[i]:first[i+1]``.
    """
    raw, offsets = text_buffer(texts)
    n = len(offsets) - 1
    if raw.size == 0:
        return np.empty(0, _U), np.zeros(n + 1, np.int64)
    low = _lower[raw]
    inside = word_bytes[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    # a text's first byte begins a word and its last byte ends one
    heads = offsets[:-1][offsets[:-1] < raw.size]
    begins[heads] = inside[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    out = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + PIECE, side="right")))
        if j == i + 1 and stop[i] - start[i] > PIECE:  # one enormous word
            d = hashlib.blake2b(low[start[i]:stop[i]].tobytes(), digest_size=8).digest()
            out[i] = _U(int.from_bytes(d, "little"))
        else:
            out[i:j] = _piece(low[start[i]:stop[j - 1]], start[i:j] - start[i], stop[i:j] - start[i])
        i = j
    return out, first


def _piece(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    up, down = _pow_tables(len(b))
    sums = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * up[:len(b)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(_U))


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct, sorted hashes of one text's ``k``-word shingles.  A text of
    fewer words has its whole sequence as its one shingle; no word, none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(k, n)
    h = np.zeros(n - width + 1, _U)
    for j in range(width):
        h = h * _U(0xD6E8FEB86659FD93) + word_hashes[j:n - width + 1 + j]
    h = np.sort(mix(h + _U(width)))  # several times faster here than np.unique's hashing
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def slices_by_bytes(texts: pa.Array, limit: int):
    """(from, to) row ranges of a batch whose texts hold about ``limit`` bytes
    or less each; one longer text is a range of its own."""
    _, offsets = text_buffer(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
