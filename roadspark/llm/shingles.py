"""Hashes of word shingles, for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a shingle.
WORDS = 5

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, in order, and where each text's words start (one more at the end).

    A word is a run of letters and digits after lower-casing; bytes above ASCII count as letters.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    offsets = np.frombuffer(low.buffers()[1], "<i4")[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data))) if starts[0] == 0 else None
    if place is None:
        place = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))])
    value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _POW[place & 4095], np.uint64(0))
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets)


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, text by text, and where each text's shingles start (one more at the end).

    A text of fewer words than ``size``, but one at least, has a single shingle of all of them.
    """
    h, at = words(texts)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(count)])
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    first = np.arange(edge[-1]) - np.repeat(edge[:-1] - at[:-1], count)
    last = np.repeat(at[1:], count)
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        out += np.where(first + k < last, padded[first + k], np.uint64(k + 1)) * _ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1)
    return mix(out), edge


def multisets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, how often each occurs, and where each text's start."""
    s, edge = shingles(texts)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[edge[:-1][np.diff(edge) > 0]] = True
    at = np.flatnonzero(new)
    return s[at], np.diff(at, append=len(s)), np.searchsorted(at, edge)


def units(texts: pa.Array) -> list[np.ndarray]:
    """Each text's multiset as a sorted set of hashes of (shingle, number of its occurrence)."""
    s, n, at = multisets(texts)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    u = mix(np.repeat(s, n) + nth.astype(np.uint64) * _ODD[0])
    edge = np.concatenate([[0], np.cumsum(n)])[at]
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        out.append(np.sort(u[a:b]))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given as ``units``; 0 for two empty ones."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = int((b[at] == a).sum())
    return same / (len(a) + len(b) - same)
