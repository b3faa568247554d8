"""Token counts by rank-synchronous array merging.

A batch's new pre-tokens lie end to end in one array of symbol ids with the number of their sequence. Each round finds the
lowest rank of every sequence's adjacent pairs and merges all occurrences of that pair, in all sequences at once (of
overlapping ones, as in `aaa`, every other from the left), until no pair has a rank. What is left are the tokens. Counts are
kept by white-space chunk, in a table of bounded size, as no token reaches over white space.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings in a text count as their one token;
repeated rows give repeated results; very long texts are counted whole; an empty table gives no rows. Only the id and text columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resident import resident
from .vocabulary import Vocabulary

#: A vocabulary file is broadcast; larger ones are refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Chunks whose result a worker keeps, and the longest chunk kept.
CACHE, CACHE_CHARS = 120_000, 64
#: Symbols merged together.
BATCH_SYMBOLS = 1 << 20

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merge_ragged(vocabulary: Vocabulary, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Surviving symbols of sequences that lie end to end, `size` symbols each, and the number of the sequence each belongs to."""
    owner, symbols = np.repeat(np.arange(len(size)), size), symbols.copy()
    done_symbols, done_owner, none = [], [], len(vocabulary.merges)
    rank = np.full(len(symbols), none, np.int64)  # of the pair that begins here
    stale = np.arange(len(symbols))  # where it isn't known
    while len(symbols):
        stale = stale[stale < len(symbols) - 1]
        rank[stale] = none
        rank[-1] = none
        stale = stale[owner[stale] == owner[stale + 1]]
        rank[stale] = vocabulary.ranks(symbols[stale], symbols[stale + 1])
        first = np.flatnonzero(np.r_[True, owner[:-1] != owner[1:]])
        lowest = np.minimum.reduceat(rank, first)
        size = np.diff(np.r_[first, len(symbols)])
        going = np.repeat(lowest < none, size)
        lowest = np.repeat(lowest, size)
        if not going.all():
            done_symbols.append(symbols[~going])
            done_owner.append(owner[~going])
            symbols, owner, rank, lowest = symbols[going], owner[going], rank[going], lowest[going]
            if not len(symbols):
                break
        hit = rank == lowest
        # of a run of overlapping hits every other one merges, from the left
        before = np.r_[False, hit[:-1]]
        if (hit & before).any():
            run = np.maximum.accumulate(np.where(hit & ~before, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - run) % 2 == 0
        symbols[hit] = vocabulary.merges[rank[hit], 2]
        keep = np.r_[True, ~hit[:-1]]
        made = np.cumsum(keep)[hit] - 1  # where the merged symbols will be
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        stale = np.r_[made, made[made > 0] - 1]
    symbols, owner = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner])
    order = np.argsort(owner, kind="stable")
    return symbols[order], owner[order]


def chunk_counts(vocabulary: Vocabulary, chunks: list[str]) -> list[int]:
    """Tokens of each chunk."""
    data, size, of = vocabulary.words(chunks)
    counts, end = np.zeros(len(chunks), np.int64), np.cumsum(size)
    begin = 0
    while begin < len(size):
        base = end[begin] - size[begin]
        stop = max(begin + 1, int(np.searchsorted(end, base + BATCH_SYMBOLS, side="right")))
        part = size[begin:stop]
        _, owner = merge_ragged(vocabulary, vocabulary.first_symbols(data[base : end[stop - 1]], part), part)
        np.add.at(counts, of[begin:stop], np.bincount(owner, minlength=len(part)))
        begin = stop
    return counts.tolist()


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        # counts by chunk: those of late, and those of the generation before, of which what is asked for again moves on
        self.vocabulary, self.known, self.older = vocabulary, {}, {}

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > CACHE // 2:
            self.older, self.known = self.known, {}
        v, known, older = self.vocabulary, self.known, self.older
        out, pending, new = [], [], {}
        for text in texts:
            n, missing = 0, []
            for part, special in v.parts(text or ""):
                if special is not None:
                    n += 1
                    continue
                for chunk in v.chunks(part):
                    got = known.get(chunk)
                    if got is None and (got := older.get(chunk)) is not None:
                        known[chunk] = got
                    if got is None:
                        missing.append(new.setdefault(chunk, len(new)))
                    else:
                        n += got
            out.append(n)
            pending.append(missing)
        if new:
            names = list(new)
            counts = chunk_counts(v, names)
            known.update((c, n) for c, n in zip(names, counts) if len(c) <= CACHE_CHARS)
            out = [n + sum(map(counts.__getitem__, m)) if m else n for n, m in zip(out, pending)]
        return out



def read_vocabulary(path: str) -> str:
    if Path(path).stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return Path(path).read_text(encoding="utf-8")


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column in runs of about `most` bytes, with where each begins, so that a batch is never a list of strings as a whole."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(column):
        upto = (size[begin - 1] if begin else 0) + most
        end = max(begin + 1, int(np.searchsorted(size, upto, side="right")))
        yield begin, column.slice(begin, end - begin).to_pylist()
        begin = end


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident("counter", shared.value, lambda: Counter(Vocabulary(shared.value)))
        for batch in batches:
            counts = [n for _, texts in slices(batch.column("text")) for n in counter.count(texts)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": batch.column("n_bytes"),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "over_limit": pa.array([n > limit for n in counts], pa.bool_()),
                }
            )

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, COUNTS)
