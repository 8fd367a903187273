"""SuperMinHash signatures (Ertl 2017) for many sets at once.

Every element draws a random permutation of the signature's places and a
fraction per step; at step ``j`` it offers ``j + fraction`` to the place that
its permutation names, and each place keeps its smallest offer. An offer of
step ``j`` is never smaller than one of an earlier step, so a set is finished
as soon as all places hold an offer: the early stop. Here all elements of all
sets take step 0 together, then those of the unfinished sets step 1, and so on,
which gives the same minima as element by element. Offers are kept as integers,
the step in the upper and the fraction in the lower 32 bits.
"""

from __future__ import annotations

import numpy as np

from labeltext.llm.bytetext import U64, mix64

_NONE = np.iinfo(np.int64).max
_GOLD = 0x9E3779B97F4A7C15


def signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, places: int = 128) -> np.ndarray:
    """Signature matrix (n_sets x places) of int64. ``elements`` are uint64
    hashes sorted by ``owner`` (the set's number); a set without elements keeps
    the largest integer in every place."""
    sig = np.full((n_sets, places), _NONE, dtype=np.int64)
    flat = sig.reshape(-1)
    perm: np.ndarray | None = None
    live = np.bincount(owner, minlength=n_sets) > 0
    for step in range(places):
        draw = mix64(elements + U64((step + 1) * _GOLD % (1 << 64)))
        fraction = (draw >> U64(32)).astype(np.int64)
        pick = step + (((draw & U64(0xFFFFFFFF)) * U64(places - step)) >> U64(32)).astype(np.int64)
        if step == 0:
            place, first = pick, pick
        else:
            if perm is None:  # swap of step 0, for those that go on
                perm = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
                row = np.arange(len(elements))
                perm[row, first] = 0
                perm[row, 0] = first
            row = np.arange(len(elements))
            place = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[row, step]
        np.minimum.at(flat, owner * places + place, (np.int64(step) << 32) + fraction)
        live &= (sig == _NONE).any(axis=1)
        on = live[owner]
        if not on.any():
            break
        if not on.all():
            elements, owner = elements[on], owner[on]
            first = first[on]
            perm = None if perm is None else perm[on]
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One int64 key per band of ``rows`` places (n_sets x bands); the band's
    number is part of the key."""
    n, places = sig.shape
    part = sig.reshape(n, places // rows, rows).astype(U64)
    key = np.tile(mix64(np.arange(1, places // rows + 1, dtype=U64)), (n, 1))
    for k in range(rows):
        key = mix64(key * U64(0xD6E8FEB86659FD93) + part[:, :, k])
    return key.view(np.int64)
