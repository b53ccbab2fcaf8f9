"""Vectorised word and shingle hashes of text columns.

A word is a run of a-z, A-Z (as lower case), 0-9 and bytes from 0x80 on.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes that are not words become blanks, A-Z become lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_rng = np.random.Generator(np.random.PCG64(19700101))
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTES = BYTES[np.frombuffer(FOLD, np.uint8)]
IS_WORD = np.frombuffer(FOLD, np.uint8) != 32
MULT = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * U(2) + U(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * MULT[0]
    return h ^ (h >> U(29))


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[edges[i]:edges[i + 1]], and where each text's words begin."""
    on = IS_WORD[data]
    at = np.flatnonzero(on)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    first = np.ones(len(data), bool)
    first[1:] = ~on[:-1]
    inner = edges[:-1][edges[:-1] < len(data)]
    first[inner] = True
    heads = np.flatnonzero(first[at])
    lens = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lens)
    value = BYTES[data[at]] * powers(MULT[1], int(lens.max()))[place]
    h = mix(np.add.reduceat(value, heads) + lens.astype(np.uint64) * MULT[2])
    return h, np.searchsorted(at[heads], edges, "left")


def sequence_hashes(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words; 0 for texts without words."""
    n = np.diff(cuts)
    place = np.arange(len(h)) - np.repeat(cuts[:-1], n)
    top = int(n.max(initial=0))
    out = []
    for base, k in ((MULT[3], 4), (MULT[5], 6)):
        value = (h ^ (h >> U(17) if k == 6 else U(0))) * powers(base, top)[place]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        s = total[cuts[1:]] - total[cuts[:-1]]
        out.append(np.where(n > 0, mix(s + n.astype(np.uint64) * MULT[k]), U(0)))
    return out[0], out[1]


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of a text's runs of ``width`` words; a shorter text that has words is one run."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    s = np.full(n, U(width))
    for k in range(width):
        s = (s ^ (s >> U(31))) * MULT[8 + min(k, 50)] + h[k : k + n]
    return mix(s)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles made distinct by their occurrence number within the text."""
    if len(s) < 2:
        return s
    order = np.argsort(s, kind="stable")
    t = s[order]
    same = t[1:] == t[:-1]
    if not same.any():
        return s
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    nth = np.arange(len(s)) - np.repeat(heads, np.diff(np.append(heads, len(s))))
    out = s.copy()
    out[order] = np.where(nth > 0, mix(t + nth.astype(np.uint64) * MULT[60]), t)
    return out
