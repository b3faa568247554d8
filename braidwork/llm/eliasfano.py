"""Elias-Fano sequences and packed integers in one buffer, which may be a memory map.

A monotone sequence keeps its low bits packed and its high bits in unary: about two bits an element beyond the logarithm of the
mean gap. A directory of set bits before each 64-bit word answers select; a successor search goes to the elements that share the
high bits of what is looked for, and among these by halves. All look-ups take arrays and answer in arrays.
"""

from __future__ import annotations

import json
import struct

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the r-th set bit of a byte.
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _NTH[_b, _r] = _p


class Writer:
    """Named arrays, laid end to end on 8-byte bounds behind a header."""

    def __init__(self):
        self.header: dict[str, list] = {}
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, name: str, values: np.ndarray) -> None:
        data = np.ascontiguousarray(values).tobytes()
        self.header[name] = [self.size, len(values), values.dtype.str]
        self.parts += [data, b"\0" * (-len(data) % 8)]
        self.size += len(data) + -len(data) % 8

    def note(self, name: str, value: int) -> None:
        self.header[name] = int(value)

    def to_bytes(self) -> bytes:
        head = json.dumps(self.header).encode()
        head += b" " * (-len(head) % 8)
        return struct.pack("<Q", len(head)) + head + b"".join(self.parts)


class Reader:
    def __init__(self, buffer):
        size = struct.unpack_from("<Q", buffer)[0]
        self.buffer, self.begin = buffer, 8 + size
        self.header = json.loads(bytes(memoryview(buffer)[8 : 8 + size]))

    def array(self, name: str) -> np.ndarray:
        at, n, kind = self.header[name]
        return np.frombuffer(self.buffer, np.dtype(kind), n, self.begin + at)

    def number(self, name: str) -> int:
        return self.header[name]


def _to_words(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with a word more, so that a value may be read across the last border."""
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros(len(raw) // 8 + 2, np.uint64)
    out.view(np.uint8)[: len(raw)] = raw
    return out


def write_packed(w: Writer, name: str, values: np.ndarray, width: int | None = None) -> None:
    """Unsigned integers, `width` bits each (by default what the largest needs)."""
    values = np.ascontiguousarray(values, np.uint64)
    width = int(values.max()).bit_length() if width is None and len(values) else width or 0
    w.note(f"{name}.width", width)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width).ravel() if width else np.zeros(0, np.uint8)
    w.add(f"{name}.packed", _to_words(bits))


class Packed:
    def __init__(self, r: Reader, name: str):
        self.width, self.words = r.number(f"{name}.width"), r.array(f"{name}.packed")
        self.mask = np.uint64(2**self.width - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        # shifted in two steps, as a shift by 64 is none
        high = (self.words[word + 1] << np.uint64(1)) << (np.uint64(63) - off)
        return ((self.words[word] >> off) | high) & self.mask


def write_monotone(w: Writer, name: str, values: np.ndarray) -> None:
    """A sequence that never falls."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    low = max(0, (int(values[-1] + np.uint64(1)) // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(low)).astype(np.int64)
    bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
    bits[high + np.arange(n)] = 1
    words = _to_words(bits)
    before = np.zeros(len(words), np.uint32)
    np.cumsum(_POP[words.view(np.uint8)].reshape(-1, 8).sum(1)[:-1], out=before[1:])
    w.note(f"{name}.n", n)
    w.note(f"{name}.bits", len(bits))
    w.add(f"{name}.high", words)
    w.add(f"{name}.before", before)
    write_packed(w, f"{name}.low", values & np.uint64(2**low - 1), low)


_ODD, _PAIRS, _NIBBLES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _nth_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each word: bits are counted in all bytes at once, then looked up in the byte that has it."""
    r = r.astype(np.uint64)
    upto = words - ((words >> np.uint64(1)) & _ODD)
    upto = (upto & _PAIRS) + ((upto >> np.uint64(2)) & _PAIRS)
    upto = ((upto + (upto >> np.uint64(4))) & _NIBBLES) * _BYTES  # in each byte the set bits up to its end
    before = (((r * _BYTES) | _TOPS) - upto) & _TOPS  # marks the bytes with no more than r
    begin = np.bitwise_count(before).astype(np.uint64) * np.uint64(8)
    left = r - (((upto << np.uint64(8)) >> begin) & np.uint64(255))
    return (begin + _NTH[(words >> begin) & np.uint64(255), left]).astype(np.int64)


class Monotone:
    def __init__(self, r: Reader, name: str):
        self.n, self.bits = r.number(f"{name}.n"), r.number(f"{name}.bits")
        self.high, self.before, self.low = r.array(f"{name}.high"), r.array(f"{name}.before").astype(np.int64), Packed(r, f"{name}.low")
        self.zeros = 64 * np.arange(len(self.before), dtype=np.int64) - self.before

    def __len__(self) -> int:
        return self.n

    def _bit(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, at, side="right") - 1
        return word * 64 + _nth_in_word(self.high[word], at - self.before[word])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The elements at places that are all within the sequence."""
        at = np.asarray(at, np.int64)
        return ((self._bit(at) - at).astype(np.uint64) << np.uint64(self.low.width)) | self.low[at]

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements at places and those behind them, which are there too; these mostly lie in the same 64 bits."""
        at = np.asarray(at, np.int64)
        bit = self._bit(at)
        rest = (self.high[bit >> 6] >> (bit & 63).astype(np.uint64)) >> np.uint64(1)
        behind = bit + 1 + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        behind[far] = self._bit(at[far] + 1)
        width = np.uint64(self.low.width)
        return ((bit - at).astype(np.uint64) << width) | self.low[at], ((behind - at - 1).astype(np.uint64) << width) | self.low[at + 1]

    def _smaller_highs(self, high: np.ndarray) -> np.ndarray:
        """How many elements have smaller high bits: the ones before the zero that ends those."""
        k = np.maximum(high, 1) - 1
        word = np.searchsorted(self.zeros, k, side="right") - 1
        place = word * 64 + _nth_in_word(~self.high[word], k - self.zeros[word])
        return np.where(high > 0, place - k, 0)

    def _run(self, bit: np.ndarray) -> np.ndarray:
        """How many set bits follow from a place on; 64 stands for as many or more."""
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        ahead = ~((self.high[word] >> off) | ((self.high[word + 1] << np.uint64(1)) << (np.uint64(63) - off)))
        return np.bitwise_count((ahead & (~ahead + np.uint64(1))) - np.uint64(1)).astype(np.int64)

    def successor(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first element not below each value (the length where there is none), and whether it is equal."""
        value = np.asarray(value, np.uint64)
        found, equal = np.full(len(value), self.n, np.int64), np.zeros(len(value), bool)
        most = np.uint64(self.bits - self.n - 1) if self.n else np.uint64(0)
        width = np.uint64(self.low.width)
        inside = np.flatnonzero((value >> width) <= most) if self.n else np.zeros(0, np.int64)
        high, low = (value[inside] >> width).astype(np.int64), value[inside] & self.low.mask
        first = self._smaller_highs(high)
        last = first + self._run(first + high)
        long = np.flatnonzero(last - first == 64)
        last[long] = self._smaller_highs(high[long] + 1)
        # most have few that share their high bits: the first of these is tried before the others are halved
        open_ = np.flatnonzero(first < last)
        got, want = self.low[first[open_]], low[open_]
        equal[inside[open_]] = got == want
        open_ = open_[got < want]
        first[open_] += 1
        more = open_ = open_[first[open_] < last[open_]]
        begin, end, want = first[open_], last[open_], low[open_]
        while len(open_):
            middle = (begin + end) >> 1
            below = self.low[middle] < want
            begin, end = np.where(below, middle + 1, begin), np.where(below, end, middle)
            first[open_] = begin
            left = begin < end
            open_, begin, end, want = open_[left], begin[left], end[left], want[left]
        more = more[first[more] < last[more]]
        equal[inside[more]] = self.low[first[more]] == low[more]
        found[inside] = first
        return found, equal
