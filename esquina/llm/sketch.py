"""Word shingles of a text and their fast similarity sketch."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S32 = (np.uint64(n) for n in (30, 27, 31, 32))
# White space as bytes.split has it; a random number for each byte; bytes that are hashed at once.
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, in order: the sum of a mix of each byte and its place, mixed with the length."""
    raw = np.frombuffer(text or b"", np.uint8)
    if len(raw) <= _SLICE:
        return _word_hashes(raw)
    spaces = np.flatnonzero(_SPACE[raw])
    at = np.searchsorted(spaces, np.arange(_SLICE, len(raw), _SLICE))
    cuts = np.unique(spaces[at[at < len(spaces)]])
    return np.concatenate([_word_hashes(part) for part in np.split(raw, cuts)])


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    size = edges[1::2] - edges[::2]
    if not len(size):
        return np.empty(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(1, size.sum() + 1) - np.repeat(first, size)
    each = mix(_BYTES[raw[inside[1:-1]]] ^ (place.astype(np.uint64) * _STEP))
    return mix(np.add.reduceat(each, first) ^ (size.astype(np.uint64) * _MIX1))


class Shingles:
    """Fingerprints of the distinct shingles of ``size`` words, ascending."""

    def __init__(self, size: int):
        self.size = size

    def of(self, text: bytes | None) -> np.ndarray:
        ids = word_hashes(text.lower() if text else None)
        if not len(ids):
            return np.empty(0, np.uint64)
        k = min(self.size, len(ids))
        n = len(ids) - k + 1
        run = np.full(n, np.uint64(k))
        for j in range(k):
            run = mix((run + _STEP) ^ ids[j : j + n])
        return np.unique(run)


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a non-empty set; two sets agree in one with a probability of their similarity.

    Round after round every item falls into a bin by its hash for that round; a bin keeps its smallest value, and a
    later round's values are all larger. After ``size`` such rounds one round for each bin puts every item into that
    bin, so that each coordinate is filled. Rounds that come after the last bin is filled change nothing.
    """
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    per_step = max(1, math.ceil(1.3 * size * math.log(size + 1) / len(items)))
    first, empty = 0, True
    while first < size and empty:
        rounds = np.arange(first, min(first + per_step, size), dtype=np.uint64)
        h = mix(items[:, None] ^ mix((rounds + np.uint64(1)) * _STEP)[None, :])
        bins = ((h >> _S32) % np.uint64(size)).astype(np.int64)
        values = (rounds[None, :] << _S32) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, bins.ravel(), values.ravel())
        first += per_step
        empty = bool((out == np.iinfo(np.uint64).max).any())
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        h = mix(items ^ mix(np.array([size + b + 1], np.uint64) * _STEP))
        out[b] = (np.uint64(size + int(b)) << _S32) | (h & np.uint64(0xFFFFFFFF)).min()
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One key for each run of ``rows`` coordinates; the number of the band is part of it."""
    bands = coordinates.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64) * _STEP
    for j in range(rows):
        key = mix((key + _STEP) ^ bands[:, j])
    return key


def set_digest(items: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def coordinate_bits(coordinates: np.ndarray, size: int) -> list[int]:
    """One bit of each of the first ``size`` coordinates, as signed 64-bit numbers."""
    return np.packbits(mix(coordinates[:size]) >> np.uint64(63) == 1).view("i8").tolist()
