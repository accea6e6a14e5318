"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (ASCII only); a
document's set holds its distinct 5-word shingles, or its whole word sequence
as one shingle when it has fewer words, or nothing without words.

Hashes: every byte maps to a fixed random 64-bit value, a word is a polynomial
over its bytes modulo 2**64, a shingle a second polynomial over five mixed word
hashes. Equal shingles have equal hashes; different ones collide with a chance
of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
CHUNK_BYTES = 2 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_COEF = _rng.integers(1, 2**63 - 1, WIDTH + 1, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            np.cumprod(a, out=a)
            _powers[key] = a
    return _powers["p"][:n], _powers["i"][:n]


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with at most ``limit`` bytes
    (one longer text is a run of its own). Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_utf8())
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, len(texts))
        yield a, data[off[a]: off[b]], off[a: b + 1] - off[a]
        a = b


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, row) of every word of a run of texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    solid = ~_SPACE[data]
    first = np.zeros(n, bool)  # a text's first byte starts a word even right after another text
    first[off[:-1][off[:-1] < n]] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:]
    start = np.flatnonzero(begin)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    p, inv = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(off, start, side="right") - 1
    return h, start, end, row


def shingles_of(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text of a run."""
    h, _, _, row = words_of(data, off)
    docs = len(off) - 1
    bounds = np.searchsorted(row, np.arange(docs + 1))
    grams = np.zeros(0, np.uint64)
    if len(h) >= WIDTH:
        grams = h[: len(h) - WIDTH + 1] * _COEF[0]
        for k in range(1, WIDTH):
            grams = grams + h[k: len(h) - WIDTH + 1 + k] * _COEF[k]
        grams = mix(grams)
    for d in range(docs):
        a, b = bounds[d], bounds[d + 1]
        if b - a >= WIDTH:
            yield np.unique(grams[a: b - WIDTH + 1])
        elif b > a:
            yield mix((h[a:b] * _COEF[1: 1 + b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield grams[:0]
