"""SuperMinHash signatures of shingle sets, worked out for a batch of documents at once.

Element e contributes to slot k the value r + j, where j is the rank of k in a permutation drawn for e and r a fraction
drawn for (e, j); the ranks of one element over the slots are correlated (each rank once), which gives the estimate less
variance than independent minima. A slot keeps its least value. Rank j can't improve a document whose slots all lie below
j, so documents drop out early: for n elements and m slots after about m log(m) / n of the m rounds.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of the permutations worked on at once.
PART_BYTES = 1 << 25


def _ranks(slots: int) -> type:
    return np.uint8 if slots <= 1 << 8 else np.uint16 if slots <= 1 << 16 else np.uint32


def _least(values: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    """(n, slots): the least value of each slot over the elements of each owner."""
    seed = mix(values.astype(np.uint64) * _STEP + np.uint64(1))
    least = np.full((n, slots), np.inf)
    flat = least.reshape(-1)
    perm = np.tile(np.arange(slots, dtype=_ranks(slots)), (len(values), 1))
    row, first = np.arange(len(values)) * slots, owner * slots
    alive = np.flatnonzero(np.bincount(owner, minlength=n))
    for j in range(slots):
        draw = mix(seed + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        k = row + (j + ((draw >> np.uint64(40)).astype(np.uint32) % np.uint32(slots - j)).astype(np.int64))
        fraction = (draw & np.uint64(0xFFFFFFFFFF)).astype(np.float64)
        fraction *= 1 / float(1 << 40)
        fraction += j
        cells = perm.reshape(-1)
        slot = cells[k]
        cells[k] = perm[:, j]
        np.minimum.at(flat, first + slot, fraction)
        going = least[alive].max(axis=1) >= j + 1
        if going.all():
            continue
        alive = alive[going]
        if not len(alive):
            break
        wanted = np.zeros(n, bool)
        wanted[alive] = True
        keep = np.flatnonzero(wanted[owner])
        if len(keep) < 0.8 * len(owner):
            owner, seed, perm, first, row = owner[keep], seed[keep], perm[keep], first[keep], row[: len(keep)]
    return least


def signatures(values: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """(documents, slots) uint64. Equal slots occur with the Jaccard similarity as probability. No document may be empty.

    Works through so many elements at a time that their permutations take PART_BYTES, so neither a very long document nor a long
    signature takes more memory than others.
    """
    part = max(1, PART_BYTES // (slots * np.dtype(_ranks(slots)).itemsize))
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    least = np.full((n, slots), np.inf)
    for at in range(0, len(values), part):
        mine = owner[at : at + part]
        low = mine[0]
        rows = slice(low, mine[-1] + 1)
        least[rows] = np.minimum(least[rows], _least(values[at : at + part], mine - low, mine[-1] + 1 - low, slots))
    return mix(least.view(np.uint64))


def band_keys(sig: np.ndarray, rows: int, salt: np.ndarray) -> np.ndarray:
    """(documents, slots // rows) int64 keys of the bands, below 2^48, which packs better; salt keeps apart what must not meet."""
    parts = sig[:, : sig.shape[1] // rows * rows].reshape(len(sig), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]) + salt[:, None]
    for i in range(rows):
        key = mix(key * _STEP + parts[:, :, i])
    return (key >> np.uint64(16)).view(np.int64)


def planes(sig: np.ndarray) -> np.ndarray:
    """(documents, 2) int64: two bits of each of the first 64 slots, one plane of bits each."""
    return np.concatenate([np.packbits((sig[:, :64] >> np.uint64(b)) & np.uint64(1) == 1, axis=1, bitorder="little").view(np.int64) for b in (0, 1)], axis=1)
