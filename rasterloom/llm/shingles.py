"""Hashed word shingles of whole texts, vectorised over UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64

#: One random odd number and its inverse modulo 2**64; powers of it weigh the bytes of a word by place.
BASE = 0xD1342543DE82EF95
UNBASE = pow(BASE, -1, 1 << 64)
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, UNBASE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


#: Bytes that are hashed at a time; a longer stretch is cut at white space or between rows.
WINDOW = 1 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased) and each text's first word.

    ``data`` and ``offsets`` are a string column's bytes and row offsets; words don't cross rows. Memory is some fifty bytes for each
    byte of a window and a few for each byte of the whole; a window ends where a word does, so it is as long as one word at least.
    """
    n, parts, at, start = len(data), [], np.zeros(len(offsets), np.int64), 0
    while start < n:
        end = min(start + WINDOW, n)
        while end < n:
            edge = max(int(offsets[np.searchsorted(offsets, end, "right") - 1]), start)
            blank = data[max(start, end - 4096) : end]
            blank = np.flatnonzero((blank == 32) | ((blank >= 9) & (blank <= 13)))
            cut = max(edge, max(start, end - 4096) + int(blank[-1]) + 1 if len(blank) else start)
            if cut > start:
                end = cut
                break
            end = min(end + 4096, n)  # a word of more than a window
        hashes, first = _window_hashes(data[start:end], np.clip(offsets, start, end) - start)
        parts.append(hashes)
        at += first
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), at


def _window_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    start, end = solid.copy(), solid.copy()
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before = solid[:-1].copy()
    before[edges - 1] = False
    start[1:] &= ~before
    after = solid[1:].copy()
    after[edges - 1] = False
    end[:-1] &= ~after
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    up, down = powers(1 << max(16, int(n - 1).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[low] * up[:n], dtype=np.uint64)])
    return mix64((total[last + 1] - total[first]) * down[first]), np.searchsorted(first, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; of fewer words, of the whole sequence."""
    words, at = word_hashes(data, offsets)
    if len(words) >= k:
        joint = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            joint = mix64(joint) + words[j : len(words) - k + 1 + j]
        joint = mix64(joint)
    else:
        joint = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(distinct(joint[a : b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix64(np.array([h]))[0] ^ w
            out.append(mix64(np.array([h, ], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]
