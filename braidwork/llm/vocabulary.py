"""A word-level BPE vocabulary file: normaliser, pre-tokens and merge tables, as the tokenizers library defines them."""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from functools import cache, cached_property

import numpy as np
import regex

#: The file's pre-token pattern and the strings of its special tokens come from the file itself.
_SPACE = regex.compile(r"\p{White_Space}+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")

# Where the library's Unicode tables differ from Python's (15.1), as code points or ranges in hexadecimal.
#: Letters and numbers of the library's pattern engine (Unicode 16) that Python does not know.
LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Lower-casing (Unicode 17) that Python does not know: ranges with the distance to the lower-case letter.
LOWERED = [("1C89", 1), ("A7CB", 0x264 - 0xA7CB), ("A7CC", 1), ("A7CE", 1), ("A7D2", 1), ("A7D4", 1), ("A7DA", 1), ("A7DC", 0x19B - 0xA7DC), ("10D50-10D65", 0x20), ("16EA0-16EB8", 0x1B)]
#: Marks that the library's composition (Unicode 9) does not order or compose, as it does not know them.
UNORDERED = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 "
    "1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def _ranges(table: str) -> list[tuple[int, int]]:
    """First and last code point of each range."""
    return [(int(r.partition("-")[0], 16), int(r.rpartition("-")[2], 16)) for r in table.split()]


def _inside(ranges: list[tuple[int, int]]) -> str:
    """The ranges as the inside of a pattern's set."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _known(kinds: tuple[str, ...]) -> list[tuple[int, int]]:
    """Ranges of the code points whose category, in Python's tables, begins with one of kinds."""
    has = np.array([unicodedata.category(chr(c)).startswith(kinds) for c in range(sys.maxunicode + 1)], np.int8)
    edge = np.flatnonzero(np.diff(np.r_[0, has, 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


#: A character from the first of UNORDERED on.
_HIGH = regex.compile("[\u07fd-\U0010ffff]")


@cache
def _odd() -> tuple[regex.Pattern, dict[int, int], dict[str, str]]:
    """The characters that part what composes; lower-casing; classes: where the library's tables differ from Python's."""
    lowered = {c: c + by for r, by in LOWERED for a, b in _ranges(r) for c in range(a, b + 1)}
    apart = _inside(_ranges(UNORDERED))
    classes = {"L": _inside(_known(("L",)) + _ranges(LETTERS)), "N": _inside(_known(("N",)) + _ranges(NUMBERS))}
    return regex.compile(f"([{apart}])"), lowered, classes


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Of a tokenizer.json whose model is BPE with a word-end suffix and whose pre-tokenizer is a pattern, then bytes."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self._refuse_others(spec)
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        spelled = pattern.replace(r"\s", r"\p{White_Space}")
        self._pattern, spelled_plain = regex.compile(spelled), spelled
        # the same with classes spelled out, for text with characters that Python's tables treat otherwise
        for name, inside in _odd()[2].items():
            spelled = spelled.replace(rf"\p{{{name}}}", inside)
        self._spelled = regex.compile(spelled)
        self._lines = regex.compile(f"{spelled_plain}|\n")
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._opening = os.path.commonprefix(list(self.special))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = np.array([[self.ids[a], self.ids[b], self.ids[a + b]] for a, b in merges], np.int64)

    @staticmethod
    def _refuse_others(spec: dict) -> None:
        """This module knows one kind of file: NFC, white space to one space, lower case; a pattern, then bytes; no decoder."""
        steps = [(s["type"], s.get("pattern"), s.get("content")) for s in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = [(p["type"], p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        model, pattern = spec["model"], next((p["pattern"].get("Regex", "") for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"), "")
        known = {
            "normalizer": steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)],
            "pre-tokenizer": pre == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)],
            "pattern": r"\p{" not in regex.sub(r"\[[^]]*\]", "", pattern),  # classes stand inside of sets, where they can be spelled out
            "decoder": spec["decoder"] is None,
            "model": model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
            "added tokens": not any(t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")),
        }
        if unknown := [k for k, right in known.items() if not right]:
            raise ValueError(f"a vocabulary file of another kind: {', '.join(unknown)}")

    @cached_property
    def size(self) -> int:
        return max(self.names) + 1

    @cached_property
    def pair_tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hash tables from left * size + right to a merge's rank: each holds the keys that collided in those before it."""
        keys, ranks, tables = self.merges[:, 0] * self.size + self.merges[:, 1], np.arange(len(self.merges)), []
        while len(keys):
            slot = self._slot(keys, len(tables))
            table, rank = np.full(1 << self._BITS, -1, np.int64), np.full(1 << self._BITS, len(self.merges), np.int64)
            table[slot], rank[slot] = keys, ranks
            lost = table[slot] != keys
            tables.append((table, rank))
            keys, ranks = keys[lost], ranks[lost]
        return tables

    _BITS = 19

    def _slot(self, keys: np.ndarray, table: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * table & (2**64 - 1))) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of merging each pair; len(merges) where they don't merge."""
        want = left * self.size + right
        out = np.full(len(want), len(self.merges), np.int64)
        for i, (table, rank) in enumerate(self.pair_tables):
            slot = self._slot(want, i)
            hit = table[slot] == want
            out[hit] = rank[slot[hit]]
        return out

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special tokens: (string, id of the special token or None)."""
        if self._specials is None or self._opening not in text:
            return [(text, None)]
        return [(p, self.special.get(p)) for p in self._specials.split(text) if p]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Runs without white space. No pre-token and no composition reaches over white space, so each can be encoded by itself."""
        if _ODD_SPACE.search(text):  # str.split() parts at these, the normaliser doesn't
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def pre_tokens(self, chunk: str) -> list[str]:
        """The chunk normalised and cut into pre-tokens."""
        pattern = self._pattern
        if not chunk.isascii():
            if self._is_odd(chunk):
                pattern, (apart, lowered, _) = self._spelled, _odd()
                chunk = "".join(unicodedata.normalize("NFC", x) for x in apart.split(chunk)).translate(lowered)
            else:
                chunk = unicodedata.normalize("NFC", chunk)
            chunk = chunk.replace("Σ", "σ")  # characters are lowered one by one: no final sigma
        return pattern.findall(chunk.lower())

    @staticmethod
    def _is_odd(chunk: str) -> bool:
        """Whether Python's tables may treat a character otherwise than the library's; what they don't know is not printable for them."""
        return not chunk.isprintable() or (_HIGH.search(chunk) is not None and _odd()[0].search(chunk) is not None)

    def words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pre-tokens end to end, the bytes of each, and the chunk of each.

        Chunks without odd characters are normalised and cut as one text: nothing reaches over the line ends between them.
        """
        odd = [not c.isascii() and self._is_odd(c) for c in chunks]
        text = "\n".join("" if o else c for o, c in zip(odd, chunks))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        found = self._lines.findall(text.lower())
        line = np.fromiter((f == "\n" for f in found), bool, len(found))
        of = np.cumsum(line)[~line]
        made = [f.encode("utf-8", "surrogatepass") for f in found if f != "\n"]
        for i in [i for i, o in enumerate(odd) if o]:
            own = [p.encode("utf-8", "surrogatepass") for p in self.pre_tokens(chunks[i])]
            made += own
            of = np.r_[of, np.full(len(own), i)]
        size = np.fromiter(map(len, made), np.int64, len(made))
        return np.frombuffer(b"".join(made), np.uint8), size, of.astype(np.int64)

    @cached_property
    def symbol_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Id of each byte's symbol, inside a word and at its end."""
        symbols = byte_symbols()
        return np.array([self.ids[c] for c in symbols]), np.array([self.ids[c + self.suffix] for c in symbols])

    def first_ids(self, word: bytes) -> list[int]:
        """Ids of a word's symbols before any merge; the last carries the word end."""
        inner, last = self.symbol_ids
        return inner[list(word[:-1])].tolist() + [int(last[word[-1]])]

    def first_symbols(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """As first_ids, of words end to end."""
        inner, last = self.symbol_ids
        out = inner[data]
        end = np.cumsum(size) - 1
        out[end] = last[data[end]]
        return out

    @cached_property
    def bytes_of(self) -> dict[int, tuple[bytes, bool]]:
        """Of every entry but special ones: its bytes, and whether it carries the word end."""
        byte = {c: b for b, c in enumerate(byte_symbols())}
        out = {}
        for name, i in self.ids.items():
            end = bool(self.suffix) and name.endswith(self.suffix) and len(name) > len(self.suffix)
            body = name[: -len(self.suffix)] if end else name
            if name not in self.special and all(c in byte for c in body):
                out[i] = bytes(byte[c] for c in body), end
        return out
