"""Word and shingle hashes of whole texts, vectorized with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. A shingle is a run of ``n`` words; a text with fewer words is one
shingle, a text without words has none. Hashes are 64-bit; a long text is
hashed in pieces, so temporary arrays stay small whatever its length.
"""

from __future__ import annotations

import hashlib

import numpy as np

_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: a random 64-bit number per byte value
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _BYTE[_LOWER]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(4096)


def _pow_table(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = _powers(max(n, 2 * len(_POW)))
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """One uint64 per word, in order."""
    sums, lens, inside = [], [], 0  # inside: bytes so far of a word that goes on
    for at in range(0, len(data), _PIECE):
        b = np.frombuffer(data, np.uint8, min(_PIECE, len(data) - at), at)
        solid = ~_SPACE[b]
        edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first) == 0:
            inside = 0
            continue
        n = end - first
        offset = np.cumsum(n) - n
        pos = np.arange(int(n.sum())) - np.repeat(offset, n)
        s = np.add.reduceat(_BYTE[b[solid]] * _pow_table(int(n.max()))[pos], offset)
        if inside and first[0] == 0:  # continues the last word of the piece before
            s[0] = np.uint64((int(s[0]) * pow(_BASE, inside, 1 << 64) + int(sums[-1][-1])) & _MASK)
            n[0] += inside
            sums[-1], lens[-1] = sums[-1][:-1], lens[-1][:-1]
        sums.append(s)
        lens.append(n)
        inside = int(n[-1]) if end[-1] == len(b) else 0
    if not sums:
        return np.empty(0, np.uint64)
    return mix(np.concatenate(sums) + np.concatenate(lens).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Ascending distinct shingle hashes of a text."""
    if not text:
        return np.empty(0, np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass"))
    k = min(n, len(w))
    if k == 0:
        return w
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(_BASE) + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def set_digest(s: np.ndarray) -> bytes:
    """128-bit identity of a set of hashes."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
