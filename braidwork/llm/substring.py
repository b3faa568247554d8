"""Removal of repeated word windows by de Bruijn compaction.

Every window of k words is an edge of a de Bruijn graph (from its first k - 1 words to its last k - 1). Blocks ask buckets of edge
hashes how often each edge occurs in all texts and whether the word after it is always the same. Where an edge that repeats is
always followed by one word, and the edge so reached occurs equally often, nothing branches between the two. A block cuts runs of
such edges to segments, where a window's hash says so, so that all texts cut a passage alike; segments are rows, one a block
that has it, and are compacted to paths by Spark joins, each segment with the one behind it, in rounds that double what is joined.
All occurrences of a path begin with its first edge, so one record a path, not one a window, decides: who has it, in which document
it starts first.

Source coordinates verify each segment: every occurrence is read again at (document, word, length) and digested, and it counts as
settled only if all digests agree, the same follows everywhere, and its occurrences are as many as its edges'; a path, if all
its segments are and every run of it is as long. Then no occurrence of any of its windows lies elsewhere. What is not settled
(hashes that met by chance, or a branch that a two-byte fingerprint hid) is decided window by window over 128-bit digests.

Defined results: null and empty texts have no words; fewer than k words make no window; of repeated rows with one doc_id none is
smaller, so they remove nothing from each other; a null doc_id counts as larger than any other; very long texts are whole, a block of their own;
an empty table gives no rows. Words are the runs without \\x20
and \\x09-\\x0D. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, Plan, ask, ask_keys, grouped, in_order, join_blobs, one_value, plan_for, planes, split_blobs, unplanes, write_blocks
from .scratch import finished, materialise, recorded
from .words import hashes, spans, windows

WINDOW = 13
KEPT = "doc_id long, n_words long, n_removed long, kept string"
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_LAST = 2**63 - 1
#: Stands for the word after a window where there is none, or not one always.
NO_WORD = 2**16 - 1


class Edges:
    """The windows of a block: `at` is the first word of each, `key` its hash; words are numbered through the block."""

    def __init__(self, payload: bytes, k: int):
        block = Block(payload)
        self.ids = np.where(block.null_id, _LAST, block.ids)
        self.null = block.null_id
        self.words = block.text.split()
        self.text = b" ".join(self.words)
        self.start, self.end = spans(self.text)
        first = np.zeros(len(block) + 1, np.int64)
        # words before each document, counted in the original bytes
        begun = spans(block.text)[0]
        first[:-1] = np.searchsorted(begun, block.begin)
        first[-1] = len(begun)
        self.first = first
        self.doc = np.repeat(np.arange(len(block)), np.diff(first))
        self.hash = hashes(self.text, self.start, self.end)
        key = windows(self.hash, k)
        inside = self.doc[: len(key)] == self.doc[k - 1 :] if len(key) else np.zeros(0, bool)
        self.at, self.key, self.k = np.flatnonzero(inside), key[inside], k

    def digest(self, at: int, words: int) -> bytes:
        """Of `words` words from word `at` on, joined by one space."""
        return hashlib.blake2b(self.text[self.start[at] : self.end[at + words - 1]], digest_size=16).digest()


def _ask_edges(plan: Plan, k: int):
    def question(row: dict) -> tuple[np.ndarray, list[np.ndarray]] | None:
        e = Edges(row["payload"], k)
        if not len(e.at):
            return None
        keys = plan.keys(e.key)
        # the word after each window, as two bytes; the largest where the document ends
        after = np.full(len(e.at), NO_WORD, np.uint16)
        inner = np.flatnonzero(e.at + k < len(e.doc))
        inner = inner[e.doc[e.at[inner]] == e.doc[e.at[inner] + k]]
        after[inner] = (e.hash[e.at[inner] + k] % np.uint64(NO_WORD)).astype(np.uint16)
        order, first, _ = grouped(keys)
        return keys[order][first], [np.diff(np.r_[first, len(order)]).astype(np.uint32), one_value(after[order], first)]

    return question


def _answer_edges(values: list[np.ndarray]) -> list[np.ndarray]:
    """How often an edge occurs, and whether one word follows it always."""
    times, after = values
    return [times, (after != NO_WORD).astype(np.uint8)]


SEGMENT = "head: long, next: long, windows: long, low: long, times: long, count: long, a: long, b: long, same: boolean"
SEGMENTS = f"block_id long, blob binary, heads array<long>, segments array<struct<{SEGMENT}>>"
#: Windows of a segment, on average: a path is cut where a window's hash ends in so many zeros.
CUT = np.uint64(63)


def _segments(plan: Plan, k: int):
    """Runs of unbranched edges of each block, their first edges, and the distinct segments that they are cut to, digested at their coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = _segments_of(row, plan, k)
                if found is not None:
                    blob, heads, columns = found
                    kinds = [f.type for f in pa.struct([(c, pa.bool_() if c == "same" else pa.int64()) for c in columns])]
                    struct = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds)], list(columns))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block_id": pa.array([row["block_id"]], pa.int64()),
                            "blob": pa.array([blob], pa.binary()),
                            "heads": pa.ListArray.from_arrays(pa.array([0, len(heads)], pa.int32()), pa.array(heads, pa.int64())),
                            "segments": pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct),
                        }
                    )

    return run


def _segments_of(row: dict, plan: Plan, k: int) -> tuple[bytes, np.ndarray, dict[str, np.ndarray]] | None:
    e = Edges(row["payload"], k)
    if not len(e.at):
        return None
    _, _, group = grouped(plan.keys(e.key))
    parts = [split_blobs(b) for b in in_order(row["answers"])]
    count, one = (np.concatenate([unplanes(p[i]) for p in parts])[group] for i in (0, 1))
    repeats = count >= 2
    joined = np.zeros(len(e.at), bool)  # to the edge before
    joined[1:] = repeats[1:] & (one[:-1] == 1) & (count[1:] == count[:-1]) & (e.at[1:] == e.at[:-1] + 1) & (e.doc[e.at[1:]] == e.doc[e.at[:-1]])
    head = np.flatnonzero(repeats & ~joined)
    if not len(head):
        return None

    def upto(begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Where what begins at one of the stops ends."""
        return np.r_[stop, len(e.at)][np.searchsorted(stop, begin) + 1]

    # a run goes on while edges are joined, a segment of it up to the next cut
    length = upto(head, np.flatnonzero(~joined)) - head
    cut = ~joined | ((e.key & CUT) == 0)
    seg = np.flatnonzero(repeats & cut)
    end = upto(seg, np.flatnonzero(cut))
    on = (end < len(e.at)) & joined[np.minimum(end, len(e.at) - 1)]
    follows = np.where(on, e.key[np.minimum(end, len(e.at) - 1)], 0).view(np.int64)
    at, windows = e.at[seg], end - seg
    seen = np.frombuffer(b"".join([e.digest(a, n + k - 1) for a, n in zip(at.tolist(), windows.tolist())]), np.int64).reshape(-1, 2)
    order, first, _ = grouped(e.key[seg])
    lead = order[first]
    agreed = {"next": follows, "windows": windows, "count": count[seg].astype(np.int64), "a": seen[:, 0], "b": seen[:, 1]}
    same = np.ones(len(first), bool)
    for v in (*agreed.values(), on):
        same &= np.minimum.reduceat(v[order], first) == np.maximum.reduceat(v[order], first)
    heads, number = np.unique(e.key[head].view(np.int64), return_inverse=True)
    columns = {"head": e.key[seg][lead].view(np.int64)} | {c: v[lead] for c, v in agreed.items()}
    columns["next"] = np.ma.masked_array(columns["next"], ~on[lead])
    columns |= {"low": np.minimum.reduceat(e.ids[e.doc[at]][order], first), "times": np.diff(np.r_[first, len(order)]), "same": same}
    names = [x.split(":")[0].strip() for x in SEGMENT.split(",")]
    return join_blobs([planes(x) for x in (e.at[head], length, number)]), heads, {c: columns[c] for c in names}


def compacted(segments: DataFrame) -> DataFrame:
    """Paths from segments (SEGMENT; a row for each block that has it): head, low, windows, settled of the path that begins with each segment.

    A segment is settled if its digests agree wherever it lies, it is always followed by the same, and its occurrences are as many as
    its edges'. Each round joins every open path to the one that begins with the segment behind it, so paths double in length; a path
    that is through is written once and only looked up from then on.
    """
    ends = lambda c: F.min(c).eqNullSafe(F.max(c)) & (F.count(c).isin(0) | (F.count(c) == F.count("*")))
    settled = F.bool_and("same") & (F.sum("times") == F.max("count"))
    for c in ("next", "windows", "count", "a", "b"):
        settled = settled & ends(c)
    by = segments.groupBy("head").agg(F.min("low").alias("low"), F.max("windows").alias("windows"), settled.alias("settled"), F.max("next").alias("next"))
    paths = materialise(by.withColumn("next", F.when(F.col("settled"), F.col("next"))), "paths")
    through = [paths.filter("next is null")]
    open_ = paths.filter("next is not null")
    while not open_.isEmpty():
        behind = reduce(DataFrame.union, through, open_)
        behind = behind.select(F.col("head").alias("_h"), F.col("low").alias("_low"), F.col("windows").alias("_windows"), F.col("settled").alias("_settled"), F.col("next").alias("_next"))
        both = open_.join(behind, F.col("next") == F.col("_h"), "left")
        more = both.select(
            "head",
            F.least("low", "_low").alias("low"),
            (F.col("windows") + F.coalesce("_windows", F.lit(0))).alias("windows"),
            F.coalesce("_settled", F.lit(False)).alias("settled"),
            F.col("_next").alias("next"),
        )
        paths = materialise(more, "paths")
        through.append(paths.filter("next is null"))
        open_ = paths.filter("next is not null")
    return reduce(DataFrame.union, through).drop("next")


def _verdicts(row: dict) -> tuple[np.ndarray, ...]:
    """Of each run in the block: first word, windows, smallest document that has its path, settled."""
    at, length, number = (unplanes(x) for x in split_blobs(row["blob"]))
    found = sorted(row["paths"], key=lambda p: p["head"])
    low, windows, settled = (np.array([p[c] for p in found])[number] for c in ("low", "windows", "settled"))
    return at, length, low, settled & (windows == length)


def _open_windows(e: Edges, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """First words of the windows of paths."""
    return np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(at, length)])) if len(at) else np.zeros(0, np.int64)


def _window_digests(e: Edges, first: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join([e.digest(a, e.k) for a in first.tolist()]), [("a", ">u8"), ("b", ">u8")])


def _ask_windows(plan: Plan, k: int):
    def question(row: dict) -> Iterator[tuple[int, bytes]]:
        e = Edges(row["payload"], k)
        at, length, _, settled = _verdicts(row)
        first = _open_windows(e, at[~settled], length[~settled])
        if not len(first):
            return
        digests, back = np.unique(_window_digests(e, first), return_inverse=True)
        low = np.full(len(digests), _LAST)
        np.minimum.at(low, back, e.ids[e.doc[first]])
        for b, cut in plan.cut(digests["a"].astype(np.uint64)):
            yield b, join_blobs([digests[cut].tobytes(), planes(low[cut])])

    return question


def _answer_windows(blobs: list[bytes]) -> list[bytes]:
    parts = [split_blobs(b) for b in blobs]
    digests = [np.frombuffer(p[0], [("a", ">u8"), ("b", ">u8")]) for p in parts]
    low = np.concatenate([unplanes(p[1]) for p in parts])
    distinct, back = np.unique(np.concatenate(digests), return_inverse=True)
    best = np.full(len(distinct), _LAST)
    np.minimum.at(best, back, low)
    return [planes(x) for x in np.split(best[back], np.cumsum([len(d) for d in digests])[:-1])]


def _removed(row: dict, k: int) -> tuple[Edges, np.ndarray]:
    """Which words of the block go."""
    e = Edges(row["payload"], k)
    change = np.zeros(len(e.words) + 1, np.int64)

    def remove(at: np.ndarray, words) -> None:
        np.add.at(change, at, 1)
        np.subtract.at(change, at + words, 1)

    if row["blob"] is not None:
        at, length, winner, settled = _verdicts(row)
        lost = settled & (winner < e.ids[e.doc[at]])
        remove(at[lost], length[lost] + k - 1)
        if row.get("window_answers"):
            first = _open_windows(e, at[~settled], length[~settled])
            _, back = np.unique(_window_digests(e, first), return_inverse=True)
            winner = np.concatenate([unplanes(x) for x in in_order(row["window_answers"])])[back]
            first = first[winner < e.ids[e.doc[first]]]
            remove(first, k)
    return e, np.cumsum(change[:-1]) > 0


def _finish(k: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                e, gone = _removed(batch.slice(i, 1).to_pylist()[0], k)
                n_gone = np.add.reduceat(np.r_[gone, False].astype(np.int64), e.first[:-1]) * (np.diff(e.first) > 0)
                kept = []
                for d, (a, b) in enumerate(zip(e.first[:-1].tolist(), e.first[1:].tolist())):
                    if not n_gone[d]:
                        text = e.text[e.start[a] : e.end[b - 1]] if b > a else b""
                    else:
                        text = b" ".join([w for w, g in zip(e.words[a:b], gone[a:b].tolist()) if not g])
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(e.ids, pa.int64(), mask=e.null),
                        "n_words": pa.array(np.diff(e.first), pa.int64()),
                        "n_removed": pa.array(n_gone, pa.int64()),
                        "kept_sha256" if digest else "kept": pa.array(kept, pa.string()),
                    }
                )

    return run


def dedup_substrings(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, plan: Plan | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (or, with `digest`, kept_sha256) of each row.

    Digests are short, so they are written and the tables that they come from go at once.
    """
    with recorded() as worked:
        out = _dedup_substrings(docs, k, id_col, text_col, digest, plan)
    return finished(out, "substring", worked) if digest else out


def _dedup_substrings(docs: DataFrame, k: int, id_col: str, text_col: str, digest: bool, plan: Plan | None) -> DataFrame:
    blocks = write_blocks(docs, id_col, text_col)
    plan = plan or plan_for(blocks)
    payload = blocks.select("block_id", "payload")
    edges = ask_keys(payload, plan, _ask_edges(plan, k), ["sum", "one"], _answer_edges)
    found = materialise(payload.join(edges, "block_id").mapInArrow(_segments(plan, k), SEGMENTS), "segments")
    paths = compacted(found.select(F.inline("segments")))
    runs = found.select("block_id", F.explode("heads").alias("_head")).join(paths, F.col("_head") == F.col("head"))
    runs = runs.groupBy("block_id").agg(F.collect_list(F.struct("head", "low", "windows", "settled")).alias("paths"))
    decided = materialise(found.select("block_id", "blob").join(runs, "block_id"), "path-verdicts")
    by_hash = Plan(0, 1)
    by_hash.bits, by_hash.buckets = 64, plan.buckets

    def unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict({"block_id": pa.array([row["block_id"]], pa.int64()), "n": pa.array([int((~_verdicts(row)[3]).sum())], pa.int64())})

    open_ = materialise(decided.mapInArrow(unsettled, "block_id long, n long").filter("n > 0"), "unsettled")
    rows = payload.join(decided, "block_id", "left")
    if not open_.isEmpty():
        asked = payload.join(decided, "block_id").join(open_, "block_id", "left_semi")
        settled = materialise(ask(asked, _ask_windows(by_hash, k), _answer_windows).withColumnRenamed("answers", "window_answers"), "window-verdicts")
        rows = rows.join(settled, "block_id", "left")
    return rows.mapInArrow(_finish(k, digest), DIGESTS if digest else KEPT)
