"""The hashes in theta states, read from their bytes (DataSketches' compact forms, serial versions 3 and 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A state that holds the hashes of all its values has this bound: hashes lie below it.
ALL = 2**63 - 1

_FAMILY, _EMPTY = 3, 4


def _header(state: bytes) -> tuple[int, int, int, int]:
    """(bound, number of hashes, bits of each or 0 where they are plain, first byte)."""
    if not state:
        return ALL, 0, 0, 0
    longs, version, family = state[0] & 63, state[1], state[2]
    if family != _FAMILY or version not in (3, 4):
        raise ValueError(f"not a compact theta sketch that can be read here: version {version}, family {family}")
    if version == 4:  # differences of sorted hashes, packed by bits
        at = 16 if longs > 1 else 8
        bound = int.from_bytes(state[8:16], "little") if longs > 1 else ALL
        return bound, int.from_bytes(state[at : at + state[4]], "little"), state[3], at + state[4]
    if longs == 1:
        return ALL, 0 if state[5] & _EMPTY else 1, 0, 8
    bound = int.from_bytes(state[16:24], "little") if longs > 2 else ALL
    return bound, int.from_bytes(state[8:12], "little"), 0, 8 * longs


def _unpacked(data: np.ndarray, first: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The hashes of states that begin at the bytes ``first``; ``data`` goes on for nine bytes at least."""
    width = np.repeat(bits, n)
    starts = np.cumsum(n) - n
    place = (np.arange(len(width)) - np.repeat(starts, n)) * width
    byte, shift = np.repeat(first, n) + (place >> 3), (place & 7).astype(np.uint64)
    word = np.zeros(len(width), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[byte + k]
    word = (word << shift) | (data[byte + 8].astype(np.uint64) >> (np.uint64(8) - shift))
    # Sums run on from state to state, modulo 2^64; what came before a state is taken off.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word >> (64 - width).astype(np.uint64), dtype=np.uint64)])
    return (sums[1:] - np.repeat(sums[starts], n)).view(np.int64)


def hashes(states: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, bounds, numbers, hashes) for runs of states with about ``most`` hashes together."""
    texts = [s.as_buffer() if s.is_valid else b"" for s in states]
    heads = np.array([_header(bytes(memoryview(s)[:24])) for s in texts], np.int64).reshape(-1, 4)
    begin = 0
    while begin < len(texts):
        end = begin + max(1, int(np.searchsorted(np.cumsum(heads[begin:, 1]), most, side="right")))
        bounds, n, bits, at = heads[begin:end].T
        found = np.zeros(int(n.sum()), np.int64)
        packed = bits > 0
        row = np.repeat(packed, n)
        if packed.any():
            some = [np.frombuffer(texts[begin + i], np.uint8) for i in np.nonzero(packed)[0]]
            lengths = np.array([len(x) for x in some])
            data = np.concatenate([*some, np.zeros(9, np.uint8)])
            found[row] = _unpacked(data, np.cumsum(lengths) - lengths + at[packed], n[packed], bits[packed])
        plain = [np.frombuffer(texts[begin + i], "<i8", int(n[i]), int(at[i])) for i in np.nonzero(~packed & (n > 0))[0]]
        if plain:
            found[~row] = np.concatenate(plain)
        yield begin, end, bounds, n, found
        begin = end
