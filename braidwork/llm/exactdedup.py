"""Exact deduplication through a minimal perfect hash over historical digests.

History is aggregated to distinct digests, dealt to shards by digest, and each shard gets a minimal perfect hash built level
by level: a key that lands alone in a level's bit array keeps that bit, and its slot is the rank of the bit. A slot holds the
full digest, the winner's locator (its doc_id) and how many rows it stands for. Incoming digests, aggregated before they are
dealt, look up their slot and compare all 32 bytes: equal ones repeat history, the rest are no members and form groups of
their own. The result has one row per distinct digest.

Defined results: null text counts as empty; empty texts equal each other; of equal texts the row with the largest doc_id
stays (repeated rows with that doc_id all stay, a null doc_id never wins over another); very long texts are digested whole; empty tables give empty results. Only
the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import finished, materialise, recorded
from .urlfilter import LOWER, UPPER

#: Digests in a shard, on average.
SHARD_KEYS = 200_000
GAMMA = 1.5
MAX_LEVELS = 48

_INDEX = "shard long, levels array<binary>, rest array<long>, digests binary, winners binary, counts binary"
_PER_DIGEST = "digest binary, keep_id long, group_size long, member boolean"


def normalised(text: Column) -> Column:
    """The text by which rows are equal: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = a + b * np.uint64(2 * level + 1) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(digests[:, 8:16]).view("<u8").ravel(), np.ascontiguousarray(digests[:, 16:24]).view("<u8").ravel()


def build(digests: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Bit arrays of the levels, keys that no level took (by index), and the slot of each key. digests: (n, 32) uint8, distinct."""
    a, b = _halves(digests)
    slot = np.full(len(a), -1, np.int64)
    open_, levels, used = np.arange(len(a)), [], 0
    for level in range(MAX_LEVELS):
        if not len(open_):
            break
        size = max(64, int(GAMMA * len(open_)))
        at = _place(a[open_], b[open_], level, size)
        bits = np.bincount(at, minlength=size) == 1
        took = bits[at]
        rank = np.cumsum(bits) - 1
        slot[open_[took]] = used + rank[at[took]]
        used += int(bits.sum())
        levels.append(size.to_bytes(8, "little") + np.packbits(bits).tobytes())
        open_ = open_[~took]
    slot[open_] = used + np.arange(len(open_))
    return levels, open_, slot


def look_up(levels: list[bytes], n_rest: int, slot_digests: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The slot whose 32 bytes equal each digest, else -1."""
    a, b = _halves(digests)
    out, open_, used = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, raw in enumerate(levels):
        size = int.from_bytes(raw[:8], "little")
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=size).astype(bool)
        at = _place(a[open_], b[open_], level, size)
        hit, rank = bits[at], np.cumsum(bits) - 1
        out[open_[hit]] = used + rank[at[hit]]
        used += int(bits.sum())
        open_ = open_[~hit]
    if n_rest and len(open_):  # practically never: keys that collided at every level lie behind the last rank
        rest = {slot_digests[used + i].tobytes(): used + i for i in range(n_rest)}
        out[open_] = [rest.get(digests[i].tobytes(), -1) for i in open_]
    found = np.flatnonzero(out >= 0)
    same = (slot_digests[out[found]] == digests[found]).all(axis=1)
    out[found[~same]] = -1
    return out


def _bytes32(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _build_shard(table: pa.Table) -> pa.Table:
    digests = _bytes32(table["digest"])
    levels, rest, slot = build(digests)
    order = np.argsort(slot, kind="stable")
    return pa.table(
        {
            "shard": table["shard"].slice(0, 1).combine_chunks(),
            "levels": pa.array([levels], pa.list_(pa.binary())),
            "rest": pa.array([rest], pa.list_(pa.int64())),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "winners": pa.array([_longs(table["winner"])[order].tobytes()], pa.binary()),
            "counts": pa.array([_longs(table["n"])[order].tobytes()], pa.binary()),
        }
    )


def _answer_shard(incoming: pa.Table, index: pa.Table) -> pa.Table:
    new = _bytes32(incoming["digest"])
    keep, n = _longs(incoming["winner"]), _longs(incoming["n"])
    if index.num_rows:
        row = index.to_pylist()[0]
        slots = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, counts = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
        at = look_up(row["levels"], len(row["rest"]), slots, new)
        hit = at >= 0
        np.maximum.at(winners, at[hit], keep[hit])
        np.add.at(counts, at[hit], n[hit])
        digests = np.concatenate([slots, new[~hit]])
        keep, n = np.concatenate([winners, keep[~hit]]), np.concatenate([counts, n[~hit]])
        member = np.arange(len(digests)) < len(slots)
    else:
        digests, member = new, np.zeros(len(new), bool)
    return pa.table(
        {
            "digest": pa.array([x.tobytes() for x in digests], pa.binary()),
            "keep_id": keep,
            "group_size": n,
            "member": member,
        }
    )


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"))


#: Stands for a null doc_id inside the index; smaller than any other.
_NO_ID = -(2**63)


def _distinct(digests: DataFrame, shards: int) -> DataFrame:
    grouped = digests.groupBy("digest").agg(F.max(F.coalesce("doc_id", F.lit(_NO_ID))).alias("winner"), F.count("*").alias("n"))
    return grouped.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("long"))


def shards_for(rows: int) -> int:
    return max(8, -(-rows // SHARD_KEYS))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard of history's distinct digests. history: (doc_id, digest)."""
    return _distinct(history, shards).groupBy("shard").applyInArrow(_build_shard, _INDEX)


def resolve(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest of history and incoming: digest, keep_id, group_size, member (of history)."""
    new = _distinct(incoming, shards)
    out = new.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_answer_shard, _PER_DIGEST)
    return out.withColumn("keep_id", F.nullif("keep_id", F.lit(_NO_ID)))


def decide(digests: DataFrame, is_history: Column) -> DataFrame:
    """One row per input row (doc_id, digest): which row of its group stays. `is_history` parts the rows by doc_id."""
    shards = shards_for(digests.count())
    index = materialise(build_index(digests.filter(is_history), shards), "mph-index")
    groups = resolve(digests.filter(~is_history), index, shards).filter("group_size > 1")
    # Written, so that both sides of the join are dealt anew and a hot digest can be split.
    groups = materialise(groups.drop("member"), "mph-groups").withColumnRenamed("digest", "_digest")
    out = digests.join(groups, F.col("digest") == F.col("_digest"), "left")
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_history: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. History is by default the half of the ids with an even CRC."""
    with recorded() as paths:
        digests = materialise(digests_of(docs, id_col, text_col), "digests")
        if is_history is None:
            is_history = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
        out = decide(digests, is_history)
    return finished(out, "exact", paths)
