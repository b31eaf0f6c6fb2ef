"""Word shingles of a batch of texts as hashed numpy arrays.

Words are the maximal runs of a-z, 0-9 and _ after case folding. A shingle is a run of n consecutive words; a text
stands for its set of shingles. Null texts and texts with fewer than n words have the empty set.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[a-z0-9_]+")
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_CACHE_WORDS = 500_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    return [] if text is None else WORD.findall(text.casefold())


def content_key(found: list[str]) -> int:
    """Signed 64-bit key of a text's word sequence. Equal sequences, and only they but for hash accidents, share a key."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(" ".join(found))).astype(np.int64))


def shingle_sets(docs: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit shingle hashes of each document, sorted within it: (values, offsets)."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    total = int(sizes.sum())
    flat = np.fromiter(map(_HASHES.__getitem__, itertools.chain.from_iterable(docs)), np.uint64, total)
    if total < n:
        return np.empty(0, np.uint32), np.zeros(len(docs) + 1, np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    for i in range(n):
        h = mix(h * _ODD[0] + flat[i : total - n + 1 + i] * _ODD[1 + i % 2] + np.uint64(i))
    owner = np.repeat(np.arange(len(docs)), sizes)
    inside = owner[: total - n + 1] == owner[n - 1 :]
    pair = (owner[: total - n + 1][inside].astype(np.uint64) << np.uint64(32)) | (h[inside] >> np.uint64(32))
    pair.sort()  # np.unique hashes, which takes several times as long
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
    offsets = np.searchsorted(pair >> np.uint64(32), np.arange(len(docs) + 1, dtype=np.uint64)).astype(np.int64)
    return pair.astype(np.uint32), offsets


def int_lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    kind = {4: pa.int32(), 8: pa.int64()}[values.dtype.itemsize]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(f"i{values.dtype.itemsize}"), kind))
