"""BPE encoding by speculation and verification, and decoding.

A pre-token is first cut greedily: the longest vocabulary entry that begins the rest, again and again. That guess is the exact
encoding if every adjacent pair (a, b) of its tokens is compatible, that is if merging the symbols of a + b in rank order ends in
a and b again. A pair fails when some merge across the border comes early enough: take x, a piece at a's right edge that lives until
rank p (when it merges to its left), and y, a piece at b's left edge that lives until rank q; if x and y merge at rank r with r < p and
r <= q, the border falls (equal ranks merge from the left). All pairs of a batch are tested at once over arrays of edge pieces.
Words that fail a test, and guesses with a token that does not encode to itself, alone undergo exact merging.

Defined results: null and empty texts have no ids and decode to the empty text; special strings in a text become their id;
repeated rows give repeated results; very long texts and words are encoded whole; an empty table gives no rows. Decoding joins token strings by one space where the file names no decoder. Only the id
and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resident import resident
from .tokencount import CACHE, CACHE_CHARS, merge_ragged, read_vocabulary, slices
from .vocabulary import Vocabulary

ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def merge_exactly(v: Vocabulary, symbols: list[int]) -> list[int]:
    """Rank-order merging of one word."""
    symbols = list(symbols)
    while len(symbols) > 1:
        ranks = v.ranks(np.array(symbols[:-1]), np.array(symbols[1:]))
        best = int(ranks.min())
        if best == len(v.merges):
            break
        a, b, made = v.merges[best].tolist()
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
                out.append(made)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


class Trie:
    """The vocabulary's entries by their bytes, as arrays: children are found by a hash of (node, byte)."""

    _BITS = 19

    def __init__(self, entries: dict[int, tuple[bytes, bool]]):
        nodes: dict[tuple[int, int], int] = {}
        inner, last = [-1], [-1]  # id of the entry that ends at a node, without and with the word end
        for i, (data, end) in entries.items():
            node = 0
            for byte in data:
                at = nodes.get((node, byte))
                if at is None:
                    at = nodes[node, byte] = len(inner)
                    inner.append(-1)
                    last.append(-1)
                node = at
            (last if end else inner)[node] = i
        self.inner, self.last = np.array(inner, np.int32), np.array(last, np.int32)
        keys, to, self.tables = np.array([n * 256 + b for n, b in nodes], np.int64), np.array(list(nodes.values()), np.int32), []
        while len(keys):
            slot = self._slot(keys, len(self.tables))
            table, child = np.full(1 << self._BITS, -1, np.int32), np.full(1 << self._BITS, -1, np.int32)
            table[slot], child[slot] = keys, to
            lost = table[slot] != keys
            self.tables.append((table, child))
            keys, to = keys[lost], to[lost]

    def _slot(self, keys: np.ndarray, table: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x2545F4914F6CDD1D * table & (2**64 - 1))) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by a byte; -1 without one."""
        keys = node * 256 + byte
        slot = self._slot(keys, 0)
        table, child = self.tables[0]
        out = np.where(table[slot] == keys, child[slot], -1)
        missing = np.flatnonzero(out < 0)
        for i, (table, child) in enumerate(self.tables[1:], 1):
            slot = self._slot(keys[missing], i)
            hit = table[slot] == keys[missing]
            out[missing[hit]] = child[slot[hit]]
            missing = missing[~hit]
        return out

    def greedy(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words that lie end to end, and the word of each: the longest entry that begins the rest, again and again.

        All words go on by a byte at once. An entry with the word end must end the word, one without must not.
        """
        end = np.cumsum(size)
        word = np.arange(len(size))
        at = end - size
        node, place = np.zeros(len(size), np.int64), at.copy()
        best, best_place = np.full(len(size), -1, np.int64), at.copy()
        tokens, words = [], []
        while len(word):
            child = self.step(node, data[place])
            going = child >= 0
            place = place + going
            node = np.where(going, child, 0)
            over = going & (place == end[word])
            final = np.where(over, self.last[node], -1)
            inner = np.where(going & ~over, self.inner[node], -1)
            best, best_place = np.where(inner >= 0, inner, best), np.where(inner >= 0, place, best_place)
            stopped = ~going | over
            if stopped.any():
                done = final >= 0
                emit = np.flatnonzero(stopped)
                tokens.append(np.where(done[emit], final[emit], best[emit]))
                words.append(word[emit])
                # the others begin anew behind what they took
                place, node = np.where(stopped, best_place, place), np.where(stopped, 0, node)
                best = np.where(stopped, -1, best)
                if done.any():
                    word, place, node, best, best_place = (x[~done] for x in (word, place, node, best, best_place))
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words_, tokens_ = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(words_, kind="stable")  # a word's tokens were taken in their order
        return tokens_[order], words_[order]


#: Bytes of a word up to which words are matched together; longer ones are matched together by length, a factor of two at a time, or one
#: by one where there are fewer than FEW of a length.
LONG, FEW = 256, 16


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.longest = max(map(len, v.ids))
        self.trie = Trie(v.bytes_of)
        self.by_bytes = {x: i for i, x in v.bytes_of.items()}
        self.strings, self.texts = list(map(str, range(v.size))), [v.names.get(i, "") for i in range(v.size)]
        self.failures = self.words = 0
        n, none = v.size, len(v.merges)
        made_by = np.full(n, -1, np.int64)
        made_by[v.merges[:, 2]] = np.arange(none)
        # Edge pieces of every token with the rank at which each is merged away from the border (`none`: it stays).
        self.right_edge = self._edges(made_by, v.merges[:, 1], none)
        self.left_edge = self._edges(made_by, v.merges[:, 0], none)
        # Tokens that rank-order merging really yields from their own symbols.
        self.reached: dict[int, bool] = {}
        # Results by chunk: those of late, and those of the generation before, of which what is asked for again moves on.
        self.known: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}

    def _edges(self, made_by: np.ndarray, side: np.ndarray, none: int) -> list[tuple[np.ndarray, np.ndarray]]:
        piece, until, out = np.arange(self.v.size), np.full(self.v.size, none, np.int64), []
        alive = np.ones(self.v.size, bool)
        while alive.any():
            out.append((np.where(alive, piece, -1), until))
            rank = np.where(alive, made_by[piece], -1)
            alive = rank >= 0
            until = np.where(alive, rank, -1)
            piece = np.where(alive, side[np.maximum(rank, 0)], piece)
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens keeps its border under rank-order merging."""
        good = np.ones(len(left), bool)
        for x, p in self.right_edge:
            a, pa_ = x[left], p[left]
            some = a >= 0
            if not some.any():
                break
            for y, q in self.left_edge:
                b = y[right]
                test = np.flatnonzero(good & some & (b >= 0))
                if not len(test):
                    break
                rank = self.v.ranks(a[test], b[test])
                good[test[(rank < pa_[test]) & (rank <= q[right[test]]) & (rank < len(self.v.merges))]] = False
        return good

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match of one word; the last token carries the word end."""
        out, i, n = [], 0, len(word)
        while i < n:
            found = self.by_bytes.get((word[i:], True)) if n - i <= self.longest else None
            j = n
            if found is None:  # an entry of one byte there always is
                j, found = next((j, t) for j in range(min(n - 1, i + self.longest), i, -1) if (t := self.by_bytes.get((word[i:j], False))) is not None)
            out.append(found)
            i = j
        return out

    def _proper(self, token: int) -> bool:
        got = self.reached.get(token)
        if got is None:
            data, end = self.v.bytes_of[token]
            first = self.v.first_ids(data) if end else self.v.symbol_ids[0][list(data)].tolist()
            got = self.reached[token] = merge_exactly(self.v, first) == [token]
        return got

    def encode_words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie end to end, and how many each has."""
        short = size <= LONG
        begin = np.cumsum(size) - size
        if short.all():
            flat, owner = self.trie.greedy(data, size)
        else:
            parts = []
            # doublings of LONG that a word takes
            grade = np.ceil(np.log2(np.maximum(size, LONG) / LONG)).astype(np.int64)
            for g in np.unique(grade).tolist():
                own = np.flatnonzero(grade == g)
                if g and len(own) < FEW:
                    for i in own.tolist():
                        tokens = self.guess(data[begin[i] : begin[i] + size[i]].tobytes())
                        parts.append((np.array(tokens, np.int64), np.full(len(tokens), i)))
                else:
                    tokens, of = self.trie.greedy(data[np.repeat(grade == g, size)], size[own])
                    parts.append((tokens, own[of]))
            flat, owner = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.argsort(owner, kind="stable")
            flat, owner = flat[order], owner[order]
        bad = np.zeros(len(size), bool)
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[inner] * self.v.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.v.size, pairs % self.v.size)
        bad[owner[inner[~good[back]]]] = True
        tokens, back = np.unique(flat, return_inverse=True)
        proper = np.array([self._proper(int(t)) for t in tokens], bool)
        bad[owner[~proper[back]]] = True
        if bad.any():
            failed = np.flatnonzero(bad)
            ids, of = merge_ragged(self.v, self.v.first_symbols(data[np.repeat(bad, size)], size[bad]), size[bad])
            right = ~bad[owner]
            flat, owner = np.r_[flat[right], ids], np.r_[owner[right], failed[of]]
            order = np.argsort(owner, kind="stable")
            flat, owner = flat[order], owner[order]
        self.words += len(size)
        self.failures += int(bad.sum())
        return flat, np.bincount(owner, minlength=len(size))

    def _learn(self, chunks: list[str], into: dict[str, tuple[str, str, int]]) -> None:
        data, size, of = self.v.words(chunks)
        flat, count = self.encode_words(data, size)
        # odd chunks' words stand behind the others: bring tokens into the order of chunks
        per_word = np.repeat(of, count)
        flat = flat[np.argsort(per_word, kind="stable")].tolist()
        stops = np.cumsum(np.bincount(per_word, minlength=len(chunks))).tolist()
        strings, texts, begin = self.strings, self.texts, 0
        for chunk, stop in zip(chunks, stops):
            own = flat[begin:stop]
            into[chunk] = (" ".join([strings[i] for i in own]), " ".join([texts[i] for i in own]), stop - begin)
            begin = stop

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.texts.__getitem__, ids))

    def encode(self, texts: list[str | None]) -> list[tuple[str, str, int]]:
        """Of each text: its ids in decimal and its decoded text, both joined by spaces, and the number of ids."""
        v = self.v
        if len(self.known) > CACHE // 2:
            self.older, self.known = self.known, {}
        plans, new = [], {}
        for text in texts:
            plan = []
            for part, special in v.parts(text or ""):
                if special is not None:
                    plan.append((str(special), part, 1))
                else:
                    chunks = v.chunks(part)
                    plan.append(chunks)
                    for c in chunks:
                        if c not in self.known:
                            new[c] = None
            plans.append(plan)
        known, older = self.known, self.older
        kept = {c: older[c] for c in new if c in older}
        known.update(kept)
        fresh: dict[str, tuple[str, str, int]] = {}
        if len(kept) < len(new):
            self._learn([c for c in new if c not in kept], fresh)
        known.update(fresh)
        out = []
        for plan in plans:
            got = [x for p in plan for x in ((p,) if isinstance(p, tuple) else map(known.__getitem__, p)) if x[2]]
            out.append((" ".join([x[0] for x in got]), " ".join([x[1] for x in got]), sum([x[2] for x in got])))
        for c in [c for c in fresh if len(c) > CACHE_CHARS]:
            del known[c]
        return out


def _run(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = resident("codec", shared.value, lambda: Codec(Vocabulary(shared.value)))
        for batch in batches:
            for begin, texts in slices(batch.column("text")):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(begin, len(texts))} | columns(codec.encode(texts)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded text of each row."""

    def columns(rows):
        return {
            "ids": pa.array([list(map(int, r[0].split())) for r in rows], pa.list_(pa.int32())),
            "decoded": pa.array([r[1] for r in rows], pa.string()),
        }

    return _run(docs, vocabulary_path, id_col, text_col, ENCODED, columns)


def encode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, so that long results need not leave the worker."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def columns(rows):
        return {
            "n_tokens": pa.array([r[2] for r in rows], pa.int64()),
            "ids_sha256": pa.array([sha(r[0]) for r in rows], pa.string()),
            "decoded_sha256": pa.array([sha(r[1]) for r in rows], pa.string()),
        }

    return _run(docs, vocabulary_path, id_col, text_col, DIGESTS, columns)
