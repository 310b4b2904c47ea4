"""Sets of word shingles, hashed to 64 bits, computed for whole blocks of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64, utf8

#: Bytes whose words are hashed at once.
PIECE = 1 << 19
_P = 0x5851F42D4C957F2D
_INVERSE = pow(_P, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts (A-Z lower-cased, words between ASCII white space), and the bounds of each text's words."""
    data, bounds = utf8(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | (data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    begins = np.flatnonzero(inside & (first[:-1] | np.append(True, ~inside[:-1])[: len(data)]))
    ends = np.flatnonzero(inside & (first[1:] | np.append(~inside[1:], True)[: len(data)])) + 1
    hashes = np.zeros(len(begins), np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(begins // PIECE)) + 1).tolist(), len(begins)]
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            a, b = begins[i:j] - begins[i], ends[i:j] - begins[i]
            own = data[begins[i] : ends[j - 1]]
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers(_P, len(own)), out=sums[1:])
            hashes[i:j] = (sums[b] - sums[a]) * powers(_INVERSE, len(own))[a]
    hashes = mix64(hashes + mix64((ends - begins).astype(np.uint64)))
    return hashes, np.searchsorted(begins, bounds)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``size`` words of each text; a shorter text's words are one shingle, a text without words has none."""
    hashes, bounds = words(column)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            rolled[: max(0, n - k)] = mix64(rolled[: max(0, n - k)] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in hashes[a:b]:
                one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
