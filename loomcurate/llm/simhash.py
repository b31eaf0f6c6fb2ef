"""1024-bit similarity-hash fingerprints and query-directed probing of their segments.

Every shingle adds +1 or -1 to one of 1024 counters; a Walsh-Hadamard transform turns the counters into 1024 projections,
each a signed sum over all shingles, and the signs are the fingerprint. Two sets with cosine c differ in a bit with
probability arccos(c)/pi: 0.23 at Jaccard 0.6, 0.33 at 0.35, about 0.46 for unrelated texts.

Segments of `bits` bits are the join codes. The indexed side stores the code of every segment. The searching side looks up
the codes within a Hamming radius of 3 or more over its least certain bits; it ranks all (segment, flips) by their
likelihood, which follows from the sizes of its own projections, and looks up the best `probes` of them. Radius and bits
grow with `probes`, so that there are always more candidates than look-ups.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np

WIDTH = 1024
TABLES = 32
#: Bits at the front of the fingerprint that are compared in full; the segments follow them.
FIRST = 192
#: Numbers of least certain bits, each with the most flips among them; candidates ranked at a time.
_REACHES = ((8, 3), (10, 4), (12, 4), (14, 5))
_RANKED = 4_500_000
_H32 = np.array([[(-1) ** bin(i & j).count("1") for j in range(32)] for i in range(32)], np.float32)
_ORDER = np.random.default_rng(20260101).permutation(WIDTH)
_GRID = np.linspace(0, 8, 2049)


def projections(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, 1024) float32 sums from shingle_sets()."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    v = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cell = (v >> np.uint64(54)).astype(np.int64)
    sign = np.where((v >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    counters = np.bincount(owner * WIDTH + cell, sign, n * WIDTH).astype(np.float32).reshape(n, 32, 32)
    return (_H32 @ counters @ _H32).reshape(n, WIDTH).take(_ORDER, axis=1)


def fingerprints(p: np.ndarray) -> np.ndarray:
    """(documents, 16) int64 words of the 1024 bits."""
    return np.ascontiguousarray(np.packbits(p >= 0, axis=1, bitorder="little")).view(np.int64)


def segment_codes(p: np.ndarray, bits: int, tables: int = TABLES) -> np.ndarray:
    """(documents, tables) join codes. The segments follow the words compared first."""
    parts = (p[:, FIRST : FIRST + bits * tables] >= 0).reshape(len(p), tables, bits)
    return parts @ (1 << np.arange(bits)) | (np.arange(tables) << bits)


@functools.cache
def flip_sets(bits: int, probes: int, tables: int = TABLES) -> list[tuple[int, ...]]:
    """Sets of least certain bits to flip: the first reach that gives 1.4 candidates for each look-up, as far as there are so many."""
    sets: list[tuple[int, ...]] = []
    for flippable, radius in _REACHES:
        sets = [s for r in range(radius + 1) for s in itertools.combinations(range(min(bits, flippable)), r)]
        if 5 * tables * len(sets) >= 7 * probes:
            return sets
    if tables * len(sets) < probes:
        raise ValueError(f"{probes} look-ups of {bits} bits in {tables} tables, but only {tables * len(sets)} candidates")
    return sets


def probe_codes(p: np.ndarray, bits: int, probes: int, cosine: float, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest codes of a partner at the given cosine: (codes, offsets) over the documents."""
    subsets = flip_sets(bits, probes, tables)
    k, n = 1 + max((i for s in subsets for i in s), default=0), len(p)
    step = max(1, _RANKED // (tables * len(subsets)))
    if n > step:
        return np.concatenate([probe_codes(p[i : i + step], bits, probes, cosine, tables)[0] for i in range(0, n, step)]), np.arange(n + 1) * probes
    scale = np.sqrt((p**2).mean(1, keepdims=True)) + 1e-9
    margin = (np.abs(p[:, FIRST : FIRST + bits * tables]) / scale).reshape(n, tables, bits)
    steep = cosine / math.sqrt(1 - cosine * cosine)
    flip = np.array([0.5 * math.erfc(steep * m / math.sqrt(2)) for m in _GRID])
    q = np.clip(np.interp(margin, _GRID, flip), 1e-9, 0.5)
    base = -np.log1p(-q).sum(2)
    odds = np.log((1 - q) / q)
    least = np.argpartition(odds, k - 1, axis=2)[:, :, :k]
    odds = np.take_along_axis(odds, least, 2)
    least = 1 << least
    cost = np.stack([base + sum(odds[:, :, i] for i in s) if s else base for s in subsets], 2).reshape(n, -1)
    best = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
    flips = np.stack([sum((least[:, :, i] for i in s), np.zeros((n, tables), np.int64)) for s in subsets], 2).reshape(n, -1)
    codes = np.take_along_axis(segment_codes(p, bits, tables), best // len(subsets), 1) ^ np.take_along_axis(flips, best, 1)
    return codes.ravel(), np.arange(n + 1) * probes
