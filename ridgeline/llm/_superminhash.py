"""SuperMinHash signatures of many sets at once (numpy, inside tasks).

For each element, round j draws a value in [j, j + 1) and the j-th entry of a random
permutation of the slots, built by swaps. A slot keeps its smallest value. All elements
go through a round together: once every slot of a set is filled, later rounds hold only
larger values, so the set is done (early stopping). Sets of many elements end after two
or three rounds, and the ranks of an element are correlated over the slots, which gives
the lower variance.
"""

from __future__ import annotations

import numpy as np

from ._text import mix

_U = np.uint64
_OPEN = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray], m: int = 252, chunk: int = 40_000) -> np.ndarray:
    """One row of ``m`` slot fingerprints (uint8) for each set; zeros for an empty set.

    A fingerprint is eight bits of the element that holds the slot, so two sets agree
    in a slot with probability J + (1 - J) / 256. At most 255 slots.
    """
    out = np.zeros((len(sets), m), np.uint8)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= chunk):
            size += len(sets[last])
            last += 1
        out[first:last] = _batch(sets[first:last], m)
        first = last
    return out


def _batch(sets: list[np.ndarray], m: int) -> np.ndarray:
    n = np.array([len(s) for s in sets])
    slots = np.full((len(sets), m), _OPEN, _U)
    h = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    doc = np.repeat(np.arange(len(sets)), n)
    perm = None
    flat = slots.reshape(-1)
    for j in range(m):
        if not len(h):
            break
        x = mix(h + _U(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((x & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64))
        if j == 0:
            slot = k
        else:
            if perm is None:
                perm = _replay(h, m, j)
            at = np.arange(len(h))
            slot, mine = perm[at, k].astype(np.int64), perm[at, j].copy()
            perm[at, k] = mine
            perm[at, j] = slot
        value = (_U(j) << _U(56)) | (mix(x ^ _U(0x2545F4914F6CDD1D)) >> _U(8))
        np.minimum.at(flat, doc * m + slot, value)
        open_docs = (slots == _OPEN).any(1)
        more = open_docs[doc]
        if not more.all():
            h, doc = h[more], doc[more]
            perm = None if perm is None else perm[more]
    out = (mix(slots) >> _U(56)).astype(np.uint8)
    out[n == 0] = 0
    return out


def _replay(h: np.ndarray, m: int, rounds: int) -> np.ndarray:
    """The permutations of elements after their first ``rounds`` swaps."""
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
    at = np.arange(len(h))
    for j in range(rounds):
        x = mix(h + _U(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        k = j + (((x & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)
        mine = perm[at, j].copy()
        perm[at, j] = perm[at, k]
        perm[at, k] = mine
    return perm


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signature rows, by broadcasting."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)
