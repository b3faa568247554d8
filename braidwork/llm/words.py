"""Vectorised word splitting and hashing over UTF-8 buffers."""

from __future__ import annotations

import numpy as np

#: Bytes that part words: \x20 and \x09-\x0D. UTF-8 continuation bytes never fall among them.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)


def lower_ascii(data: bytes) -> bytes:
    """Lower-cases A-Z only."""
    return data.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x.copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~SPACES[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(inside))
    return edge[0::2], edge[1::2]


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, most: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word, or of its first `most` bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    ends = ends if most is None else np.minimum(ends, starts + most)
    size = ends - starts
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    place = np.arange(first[-1] + size[-1], dtype=np.int64) - np.repeat(first, size)
    value = _BYTE[raw[place + np.repeat(starts, size)]]
    if size.max() > len(_PLACE):  # places beyond the table have factors of their own
        far = np.flatnonzero(place >= len(_PLACE))
        value[far] *= mix(place[far].astype(np.uint64)) | np.uint64(1)
    place &= 255
    value *= _PLACE[place]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def windows(word: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words; empty when there are fewer."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(word) - n + 1, np.uint64)
    for i in range(n):
        total += word[i : len(word) - n + 1 + i] * _STEP[i % 64]
    return mix(total)


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""
