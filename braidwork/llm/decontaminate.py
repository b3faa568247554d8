"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items.

Normalising lower-cases A-Z and takes words of digits, letters and all non-ASCII characters. A window is 13 words of an item (an item
of fewer is one window). The automaton does not hold every window, which would hold each word of an item 13 times: of every seven words of
an item it holds the first four, for any 13 words have one such block of seven whole. It reads each text once; where a pattern ends, text and
item are held against each other word by word to either side, and what agrees over 13 words or more is a run of windows. Four
words that begin more than HEAVY blocks are replaced by all seven, and seven such by the windows around them, so that few places
are compared for nothing. Short items are patterns themselves. A word goes in as two letters, of its number, so that no node has many
children. Ordinals of words map to bytes and characters of the original.

Items are made distinct by their words, with all ids that have them, before they leave Spark, and those without words are left out. The
automaton is broadcast as its items, whose size is checked first: beyond `MAX_ITEM_BYTES` the items are dealt to passes by hash, an
item larger than a pass is cut to pieces that overlap, and the texts are scanned once a pass. Driver and workers then hold one pass's
items at a time, and the hits of a text, written by each pass, are united by a key of its row.

Defined results: null or empty text has no words and is never contaminated; items without words have no window; the
windows of an item with a null id count as hits, but no id is listed for them; repeated rows give repeated results; an empty
benchmark hits nothing; an empty table of documents gives no rows; very long texts are read whole. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resident import release, resident
from .scratch import drop, materialise, recorded
from .tokencount import slices
from .words import encode

WINDOW = 13
#: Of item texts and ids that one automaton is made of; it takes some 30 times as much memory.
MAX_ITEM_BYTES = 16 << 20

#: Word bytes keep themselves, A-Z lower-cased; all others of ASCII part words.
_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

HITS = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    return encode(text).translate(_TABLE).split()


#: Words of a block that are looked for, and places of a pattern from which more words are.
SEED, HEAVY = 4, 64


class Matcher:
    """items: (ids, text) pairs, the ids those of all items with these words."""

    def __init__(self, items: list[tuple[list[str], str]], n: int = WINDOW):
        self.n = n
        self.number: dict[bytes, int] = {}
        self.ids = [ids for ids, _ in items]
        # words of all items, with -1 around each, the item of each, and where blocks begin
        self.words, self.owner = array("i", [-1]), array("i", [0])
        block, blocks, whole = (n + 1) // 2, array("i"), {}
        for k, (_, text) in enumerate(items):
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if 0 < len(own) < n:
                whole.setdefault(tuple(own), set()).add(k)
            blocks.extend(range(len(self.words), len(self.words) + len(own) - block + 1, block) if len(own) >= n else ())
            self.words.extend(own)
            self.words.append(-1)
            self.owner.extend([k] * (len(own) + 1))
        self._name_words()
        self.automaton = ahocorasick.Automaton()
        for size in (min(SEED, block), block):
            at: dict[bytes, array] = {}
            for q in blocks:
                at.setdefault(self.words[q : q + size].tobytes(), array("i")).append(q)
            blocks = array("i")
            for places in at.values():
                if len(places) > HEAVY:
                    blocks.extend(places)
                else:
                    self._add(self.words[places[0] : places[0] + size], places, ())
        # what is left begins too many blocks: the windows that have it
        for q in blocks:
            for first in range(q + block - n, q + 1):
                window = self.words[max(first, 0) : max(first, 0) + n]
                if len(window) == n and -1 not in window:
                    whole.setdefault(tuple(window), set()).add(self.owner[q])
        for window, owners in whole.items():
            self._add(window, (), sorted(owners))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def _name_words(self) -> None:
        """Two letters for each word, the first and the second from alphabets of their own, so that matches fall on words."""
        base = int(len(self.number) ** 0.5) + 1
        self.letters = {w: chr(1 + i // base) + chr(2 + base + i % base) for w, i in self.number.items()}
        self.by_number = ["\0\0", *self.letters.values()]

    def _add(self, words, places, owners) -> None:
        """A pattern; one that is there already gets the places and owners too."""
        key = "".join(map(self.by_number.__getitem__, words))
        _, places_, owners_ = self.automaton.get(key, (0, (), ()))
        self.automaton.add_word(key, (len(words), tuple(places) + tuple(places_), tuple(owners) + tuple(owners_)))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words in the text, matches as (first, last + 1) ordinals of words, ids of the items matched."""
        words = words_of(text)
        if not words or not self.some:
            return len(words), [], set()
        found = list(self.automaton.iter("".join(map(self.letters.get, words, repeat("\0\0")))))
        if not found:
            return len(words), [], set()
        line = list(map(self.number.get, words, repeat(0)))
        spans, items = [], set()
        done: dict[int, int] = {}  # of a place in the items relative to the text, up to where it has been compared
        for letter, (size, places, owners) in found:
            end = letter // 2 + 1
            begin = end - size
            if owners:
                spans.append((begin, end))
                items.update(owners)
            for place in places:
                if done.get(place - begin, -1) <= begin:
                    first, last = self._agree(line, begin, end, place)
                    done[place - begin] = last
                    if last - first >= self.n:
                        spans.append((first, last))
                        items.add(self.owner[place])
        return len(words), spans, {i for k in items for i in self.ids[k]}

    def _agree(self, line: list[int], begin: int, end: int, place: int) -> tuple[int, int]:
        """How far a text agrees with the items around words that are equal: ordinals of the first and behind the last word."""
        words, shift = self.words, place - begin
        while begin > 0 and line[begin - 1] == words[begin - 1 + shift]:
            begin -= 1
        while end < len(line) and line[end] == words[end + shift]:
            end += 1
        return begin, end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def in_original(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets in the original text of spans of word ordinals."""
    data = encode(text)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[0::2], edge[1::2]
    char = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(char[starts[a]]), "end": int(char[ends[b - 1]])} for a, b in spans]


#: Of a row: matches as (first, last + 1) ordinals of words, ids of the items.
FOUND = "_scan_of long, spans array<struct<first:long,last:long>>, ids array<string>"


def _matches(shared, n: int, batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    key, items = shared.value
    matcher = resident("matcher", (key, n), lambda: Matcher(items, n))
    for _, texts in slices(batch.column("text")):
        for text in texts:
            n_words, spans, ids = matcher.scan(text)
            yield n_words, merged(spans), ids


def _hits(batch: pa.RecordBatch, rows: list[tuple[int, list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    texts = batch.column("text")
    placed = [in_original(texts[i].as_py(), spans) if spans else [] for i, (_, spans, _) in enumerate(rows)]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": batch.column("doc_id"),
            "n_words": pa.array([r[0] for r in rows], pa.int64()),
            "n_hit": pa.array([_words_in(r[1]) for r in rows], pa.int64()),
            "item_ids": pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
            "spans": pa.array(placed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
    )


def _words_in(spans: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in spans)


def _scanner(shared, n: int, keep: bool):
    """keep: pass on the whole rows that are not contaminated, else give a row of HITS for each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_matches(shared, n, batch))
            yield batch.filter(pa.array([not contaminated(w, _words_in(s)) for w, s, _ in rows], pa.bool_())) if keep else _hits(batch, rows)

    return scan


def _finder(shared, n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, spans, sorted(ids)) for i, (_, spans, ids) in zip(batch.column("_scan_row").to_pylist(), _matches(shared, n, batch)) if spans]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            spans = [[{"first": a, "last": b} for a, b in x] for _, x, _ in found]
            yield pa.RecordBatch.from_pydict({"_scan_of": pa.array([x[0] for x in found], pa.int64()), "spans": pa.array(spans, kind), "ids": pa.array([x[2] for x in found], pa.list_(pa.string()))})

    return scan


def _uniter(keep: bool):
    """Like _scanner, of rows that bring the matches of all passes along."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            count = [len(words_of(t)) for _, texts in slices(batch.column("text")) for t in texts]
            rows = []
            for words, spans, ids in zip(count, batch.column("_scan_spans").to_pylist(), batch.column("_scan_ids").to_pylist()):
                rows.append((words, merged([(s["first"], s["last"]) for s in spans or []]), set(ids or [])))
            if keep:
                clean = batch.filter(pa.array([not contaminated(w, _words_in(s)) for w, s, _ in rows], pa.bool_()))
                yield clean.drop_columns(["_scan_row", "_scan_spans", "_scan_ids"])
            else:
                yield _hits(batch, rows)

    return unite


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def batches_of(items: list[tuple[list[str], str]], n: int, most: int) -> Iterator[list[tuple[list[str], str]]]:
    """Items of about `most` bytes together at most; longer ones in pieces that overlap by n - 1 words."""
    group, size = [], 0
    for ids, text in items:
        words = words_of(text)
        average = max(1, len(b" ".join(words)) // max(1, len(words)))
        step = max(1, most // (average + 1))
        for i in range(0, max(1, len(words) - n + 1), step):
            piece = b" ".join(words[i : i + step + n - 1]).decode("utf-8", "surrogatepass")
            if group and size + len(piece) > most:
                yield group
                group, size = [], 0
            group.append((ids, piece))
            size += len(piece)
    if group:
        yield group


def distinct_items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """ids (of all rows that have them; null ids aside) and text, of the distinct sequences of words that items have."""
    text = F.translate(F.col(item_text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    rows = benchmark.select(F.col(item_col).cast("string").alias("id"), text.alias("text")).filter("text <> ''").distinct()
    return rows.groupBy("text").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("ids", "text")


def _scanned(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, n: int, most: int, keep: bool) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    with recorded() as worked:
        items = materialise(distinct_items(benchmark, item_col, item_text_col), "decontaminate-items")
    cost = F.octet_length("text") + F.coalesce(F.aggregate("ids", F.lit(0), lambda a, i: a + F.octet_length(i)), F.lit(0))
    total = items.agg(F.sum(cost.cast("long"))).first()[0] or 0

    def share(batch: list):
        batch = sorted(batch, key=lambda x: (x[1], x[0]))
        return sc.broadcast((hashlib.sha1(repr(batch).encode("utf-8", "surrogatepass")).hexdigest(), batch))

    schema = docs.schema if keep else HITS
    if total <= most:
        shared = share([tuple(r) for r in items.collect()])
        drop(docs.sparkSession, worked)
        return docs.mapInArrow(_scanner(shared, n, keep), schema)
    keyed = materialise(docs.withColumn("_scan_row", F.monotonically_increasing_id()), "decontaminate-rows")
    texts, found = keyed.select("_scan_row", "text"), []
    passes = -(-2 * total // most)
    for i in range(passes):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == i).collect()
        for batch in batches_of([tuple(r) for r in own], n, most):
            shared = share(batch)
            found.append(materialise(texts.mapInArrow(_finder(shared, n), FOUND), "decontaminate-found"))
            shared.unpersist()
    drop(docs.sparkSession, worked)
    united = reduce(DataFrame.union, found).groupBy("_scan_of").agg(F.flatten(F.collect_list("spans")).alias("_scan_spans"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("_scan_ids"))
    united = materialise(united, "decontaminate-united")
    return keyed.join(united, F.col("_scan_row") == F.col("_scan_of"), "left").drop("_scan_of").mapInArrow(_uniter(keep), schema)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) and spans (characters of the original) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _scanned(rows, benchmark, item_col, item_text_col, n, max_item_bytes, False)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated. Texts are in `text`, items in `item_id` and `text`."""
    return _scanned(docs, benchmark, "item_id", "text", n, max_item_bytes, True)
