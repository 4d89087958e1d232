"""MinHash signatures from two permutations (C-MinHash): one places the shingles, the other is shifted circularly."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

from footfall.llm import words

SPAN = 1 << 20
_ROWS = 512


@cache
def _shifts(coordinates: int, seed: int) -> np.ndarray:
    """Row p holds the second permutation at p, p + 1, ...: what all shifts of it say about place p."""
    order = np.random.default_rng(seed).permutation(SPAN).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates]]), coordinates)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles, sorted; with fewer words than ``width`` the whole sequence is one, without words none."""
    found = words.hashes(words.lower_ascii(text.encode())) if text else np.zeros(0, np.uint64)
    if 0 < len(found) < width:
        return words.runs(found, len(found)) + np.uint64(len(found))
    return np.unique(words.runs(found, width))


def signature(grams: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted by k, over the places of the set.

    The first permutation is the hash of a shingle cut to its place among 2^20.
    """
    shifted = _shifts(coordinates, seed)
    places = (grams >> np.uint64(44)).astype(np.int64)
    low = np.full(coordinates, SPAN, np.uint32)
    for at in range(0, len(places), _ROWS):
        np.minimum(low, shifted[places[at : at + _ROWS]].min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    return words.runs_of_rows(low.reshape(bands, rows).astype(np.uint64)).view(np.int64)


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
