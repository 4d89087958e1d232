"""Words of a text as 64-bit hashes, without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D. All of these are ASCII, so UTF-8 needs no decoding.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE = 1 << 16
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@cache
def _known_powers(k: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_powers(x, 2 * _PIECE) for x in (int(_ODD[k]), pow(int(_ODD[k]), -1, 1 << 64)))


def _both_powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if n <= 2 * _PIECE:
        return tuple(x[:n] for x in _known_powers(k))
    return _powers(int(_ODD[k]), n), _powers(pow(int(_ODD[k]), -1, 1 << 64), n)


def _of_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """For each range the sum of its values, each times the power of its place in the range: one sum over all is cut."""
    up, down = _both_powers(k, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """Each hash with its bits spread (multiply and shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * _ODD[2]
    x ^= x >> np.uint64(29)
    x *= _ODD[3]
    x ^= x >> np.uint64(32)
    return x


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    apart = np.ones(len(data) + 2, bool)
    apart[1:-1] = _SEPARATES[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(apart[:-1] & ~apart[1:]), np.flatnonzero(~apart[:-1] & apart[1:])


def pieces(data: bytes):
    """The text cut between words into parts of about 64 KB, so that a long text needs no more memory than that."""
    at = 0
    while len(data) - at > _PIECE:
        cut = at + _PIECE
        while cut < len(data) and not _SEPARATES[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def _hashes(data: bytes) -> np.ndarray:
    starts, ends = spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mixed(_of_ranges(byte_hashes(data), starts, ends, 0) + (ends - starts).astype(np.uint64))


def hashes(data: bytes) -> np.ndarray:
    """One hash per word, in order."""
    if len(data) <= _PIECE:
        return _hashes(data)
    return np.concatenate([_hashes(x) for x in pieces(data)])


def byte_hashes(data: bytes) -> np.ndarray:
    """One hash per byte."""
    return _BYTE[np.frombuffer(data, np.uint8)]


def runs(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """One hash per run of n consecutive words; another salt gives an independent hash."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    count = len(words) - n + 1
    out = np.full(count, _ODD[4 + salt], np.uint64)
    for j in range(n):
        out += words[j : j + count] * _ODD[6 + (j + 17 * salt) % 57]
        if j % 8 == 7:
            out = mixed(out)
    return mixed(out)


def runs_of_rows(table: np.ndarray) -> np.ndarray:
    """One hash per row, which also depends on the row's number."""
    out = words_salt(len(table))
    for j in range(table.shape[1]):
        out += mixed(table[:, j] + np.uint64(j)) * _ODD[6 + j % 57]
    return mixed(out)


def words_salt(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _ODD[5])


def prefixes(data: bytes, n: int) -> np.ndarray:
    """One hash of the first n bytes of each word that has as many."""
    starts, ends = spans(data)
    starts = starts[ends - starts >= n]
    bytes_ = np.frombuffer(data, np.uint8)
    out = np.full(len(starts), _ODD[5 + n], np.uint64)
    for j in range(n):
        out += _BYTE[bytes_[starts + j]] * _both_powers(0, n)[0][j]
    return mixed(out)


def runs_at(words: np.ndarray, places: np.ndarray, n: int, salt: int) -> np.ndarray:
    """One hash for the run of n words at each place; another salt gives an independent hash."""
    if not len(places):
        return np.zeros(0, np.uint64)
    return mixed(_of_ranges(words, places, places + n, 63 - salt) + _ODD[4 + salt])
