"""Documents in blocks, and questions that blocks put to buckets of hashes.

A block is a row of a few megabytes of texts, written once to the shared folder, so that every pass sees the same blocks. A
pass over hashes does not shuffle a row per hash: each block sends each bucket one row with its own distinct hashes, sorted
and compressed, already aggregated within the block; the bucket, one task's worth of a range of hashes, answers each block
with one row, in the order asked. A hash that a third of all texts contain thus costs one entry per block.

Buckets grow with the input, and blocks do, so rows from each block to each bucket would grow with its square. Where a row would hold
fewer than MIN_KEYS hashes, a question goes by two hops: blocks send rows to coarse ranges of hashes, where a bundle of blocks is
merged to one list of distinct hashes; the bundle asks the buckets of its range, and splits their answers among its blocks. Rows
stay at MIN_KEYS hashes or more on either hop, so they grow as the input does.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resident import release
from .scratch import materialise
from .words import encode

BLOCK_BYTES = 4 << 20
#: Entries in a bucket, on average.
BUCKET_ENTRIES = 1 << 20

BLOCKS = "words long, payload binary"
ASKED = "bucket int, block_id long, blob binary"


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(data: bytes, level: int = 1) -> bytes:
    return _compressor(level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _decompressor().decompress(data)


def planes(values: np.ndarray) -> bytes:
    """Little-endian integers with bytes of equal place together, compressed."""
    raw = np.ascontiguousarray(values)
    kind = raw.dtype.str[1:].encode()
    # laid out before it is handed on, which takes a tenth of the time of tobytes() of a transposed array
    return kind + struct.pack("<q", len(raw)) + squeeze(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T) if len(raw) else b"")


def unplanes(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:2].decode()), struct.unpack_from("<q", data, 2)[0]
    raw = np.frombuffer(unsqueeze(data[10:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def join_blobs(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def split_blobs(data: bytes) -> list[bytes]:
    n = struct.unpack_from("<q", data)[0]
    sizes, at, out = struct.unpack_from(f"<{n}q", data, 8), 8 * (n + 1), []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


class Block:
    """Ids and texts of a block; the texts lie end to end, each followed by a space."""

    def __init__(self, payload: bytes):
        ids, null, size, text = split_blobs(unsqueeze(payload))
        self.ids, self.null_id = np.frombuffer(ids, np.int64), np.frombuffer(null, bool)
        self.size, self.text = np.frombuffer(size, np.int64), text
        self.end = np.cumsum(self.size + 1)
        self.begin = self.end - self.size - 1

    def __len__(self) -> int:
        return len(self.ids)


def _pack(ids: list, texts: list[bytes]) -> bytes:
    return squeeze(
        join_blobs(
            [
                np.array([0 if i is None else i for i in ids], np.int64).tobytes(),
                np.array([i is None for i in ids], bool).tobytes(),
                np.array([len(t) for t in texts], np.int64).tobytes(),
                b"".join(t + b" " for t in texts),
            ]
        ),
        3,
    )


def write_blocks(docs: DataFrame, id_col: str, text_col: str, prepare: Callable[[bytes], bytes] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block_id, words, payload. A text larger than a block is a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_pydict({"words": pa.array([words], pa.int64()), "payload": pa.array([_pack(ids, texts)], pa.binary())})

        ids, texts, size, words = [], [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = encode(text)
                data = prepare(data) if prepare else data
                ids.append(i)
                texts.append(data)
                size += len(data) + 1
                words += 1 + len(data) // 6
                if size >= block_bytes:
                    yield row()
                    ids, texts, size, words = [], [], 0, 0
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, BLOCKS)
    return materialise(rows.withColumn("block_id", F.monotonically_increasing_id()), "blocks")


#: Hashes of a row from a block to a bucket, on average and at least.
MIN_KEYS = 256


class Plan:
    """How hashes are cut to buckets. `bits` of a 64-bit hash are sent: enough that two of `words` rarely meet by chance.

    `coarse` is 0 where blocks ask buckets, else the number of coarse ranges, `fine` buckets each, that bundles of `bundle` blocks ask from.
    """

    def __init__(self, words: int, partitions: int, blocks: int = 1):
        self.bits = min(64, max(40, 2 * int(max(words, 1)).bit_length() + 2))
        self.buckets = max(4 * partitions, -(-words // BUCKET_ENTRIES))
        self.coarse, self.fine, self.bundles = 0, self.buckets, 1
        each = words // max(1, blocks)  # of a block
        if each // self.buckets < MIN_KEYS and self.buckets > 4 * partitions:
            self.in_two_hops(max(1, each // MIN_KEYS), blocks, each)

    def in_two_hops(self, coarse: int, blocks: int, each: int) -> None:
        self.fine = -(-self.buckets // coarse)
        self.coarse = -(-self.buckets // self.fine)
        # blocks of a bundle: enough that its rows to buckets are as full, with room for hashes that blocks share
        self.bundles = max(1, blocks * each // max(1, 4 * MIN_KEYS * self.buckets))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """The bucket of each key, of ranges that are about equal: told by as many leading bits as a product with their number bears."""
        top = min(self.bits, 63 - self.buckets.bit_length())
        return ((keys >> np.uint64(self.bits - top)) * np.uint64(self.buckets) >> np.uint64(top)).astype(np.int64)

    def cut(self, keys: np.ndarray, coarse: bool = False) -> Iterator[tuple[int, slice]]:
        """The buckets, or coarse ranges, that sorted keys fall into, and which keys do; in time and memory of the keys, however many buckets there are."""
        bucket = self.bucket(keys) // (self.fine if coarse else 1)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(keys)]):
            yield int(bucket[i]), slice(i, j)

    def pack_keys(self, keys: np.ndarray) -> bytes:
        """Of sorted distinct keys: the gaps, in four bytes each where they fit."""
        gaps = np.diff(keys, prepend=keys[:1])
        narrow = not len(gaps) or gaps.max() < 2**32
        return struct.pack("<Q", int(keys[0]) if len(keys) else 0) + planes(gaps.astype(np.uint32) if narrow else gaps)

    @staticmethod
    def unpack_keys(data: bytes) -> np.ndarray:
        gaps = unplanes(data[8:]).astype(np.uint64)
        return np.cumsum(gaps, dtype=np.uint64) + np.uint64(struct.unpack_from("<Q", data)[0])


def plan_for(blocks: DataFrame) -> Plan:
    words, count = blocks.agg(F.sum("words"), F.count("*")).first()
    return Plan(words or 0, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), count)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, where each distinct key begins in it, and the number of each key's group (by position before sorting)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, first, group


def one_value(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value that a group has throughout, else the largest of the type. values lie in group order."""
    low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    return np.where(low == high, low, np.iinfo(values.dtype).max).astype(values.dtype)


#: How values of equal hashes become one; values lie in group order.
COMBINE = {"sum": lambda v, first: np.add.reduceat(v.astype(np.uint64), first), "one": one_value}


def merged(parts: list[list[np.ndarray]], how: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys of lists of (keys, values ..), their values combined, and of each list where its keys are among them."""
    order, first, group = grouped(np.concatenate([p[0] for p in parts]))
    keys = np.concatenate([p[0] for p in parts])[order][first]
    values = [COMBINE[h](np.concatenate([p[i + 1] for p in parts])[order], first) if len(first) else np.zeros(0, np.uint64) for i, h in enumerate(how)]
    return keys, values, np.split(group, np.cumsum([len(p[0]) for p in parts])[:-1])


def _pack_part(plan: Plan, keys: np.ndarray, values: list[np.ndarray]) -> bytes:
    return join_blobs([plan.pack_keys(keys), *map(planes, values)])


def _unpack_part(blob: bytes) -> list[np.ndarray]:
    keys, *values = split_blobs(blob)
    return [Plan.unpack_keys(keys), *map(unplanes, values)]


def ask_keys(rows: DataFrame, plan: Plan, question: Callable[[dict], tuple[np.ndarray, list[np.ndarray]] | None], how: list[str], answer: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """block_id and answers (array of bucket, blob) of every block that asked about keys.

    question gets a row (dict of its columns) and gives sorted distinct keys with values; `how` says how values of equal keys of
    all blocks are combined; answer gets these and gives columns, of which each block gets its keys' entries, in their order.
    """

    def cuts(keys, values, coarse: bool = False):
        for b, cut in plan.cut(keys, coarse):
            yield b, _pack_part(plan, keys[cut], [v[cut] for v in values])

    def asked_by_block(row: dict) -> Iterator[tuple[int, bytes]]:
        got = question(row)
        if got is not None and len(got[0]):
            yield from cuts(*got, bool(plan.coarse))

    def answered(blobs: list[bytes]) -> list[bytes]:
        _, values, places = merged(list(map(_unpack_part, blobs)), how)
        columns = answer(values)
        return [join_blobs([planes(c[at]) for c in columns]) for at in places]

    if not plan.coarse:
        return ask(rows, asked_by_block, answered)

    # (part, block_id, blob): part is the coarse range and the bundle of the block
    first = rows.mapInArrow(_sender(asked_by_block), ASKED)
    part = F.col("bucket").cast("long") * plan.bundles + F.pmod(F.xxhash64("block_id"), F.lit(plan.bundles))
    first = materialise(first.select(part.alias("part"), "block_id", "blob"), "asked")

    def bundle(table: pa.Table) -> pa.Table:
        keys, values, _ = merged(list(map(_unpack_part, table["blob"].to_pylist())), how)
        sent = list(cuts(keys, values))
        return pa.table({"bucket": pa.array([b for b, _ in sent], pa.int32()), "block_id": pa.array([table["part"][0].as_py()] * len(sent), pa.int64()), "blob": pa.array([x for _, x in sent], pa.binary())})

    def spread(replies: pa.Table, asks: pa.Table) -> pa.Table:
        """Answers of a bundle to its blocks."""
        got = [split_blobs(a["blob"]) for a in sorted(replies.select(["bucket", "blob"]).to_pylist(), key=lambda a: a["bucket"])]
        columns = [np.concatenate([unplanes(g[i]) for g in got]) for i in range(len(got[0]))]
        keys, _, places = merged([p[:1] for p in map(_unpack_part, asks["blob"].to_pylist())], [])
        blobs = [join_blobs([planes(c[at]) for c in columns]) for at in places]
        coarse = asks["part"][0].as_py() // plan.bundles
        return pa.table({"bucket": pa.array([coarse] * len(blobs), pa.int32()), "block_id": asks["block_id"], "blob": pa.array(blobs, pa.binary())})

    replied = first.groupBy("part").applyInArrow(bundle, ASKED).groupBy("bucket").applyInArrow(_replier(answered), ASKED)
    back = replied.groupBy("block_id").cogroup(first.groupBy("part")).applyInArrow(spread, ASKED)
    return back.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))


def ask(rows: DataFrame, question: Callable[..., Iterator[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """block_id and answers (array of bucket, blob) of every block that asked.

    question gets a row (dict of its columns) and gives (bucket, blob); answer gets the blobs that a bucket was sent and gives as
    many in the same order.
    """

    asked = rows.mapInArrow(_sender(question), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(_replier(answer), ASKED)
    return answered.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))


def _sender(question: Callable[..., Iterator[tuple[int, bytes]]]):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sent = list(question(row))
                if sent:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array([b for b, _ in sent], pa.int32()),
                            "block_id": pa.array([row["block_id"]] * len(sent), pa.int64()),
                            "blob": pa.array([x for _, x in sent], pa.binary()),
                        }
                    )

    return send


def _replier(answer: Callable[[list[bytes]], list[bytes]]):
    def reply(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table["bucket"], "block_id": table["block_id"], "blob": pa.array(answer(table["blob"].to_pylist()), pa.binary())})

    return reply


def in_order(answers: list[dict] | None) -> list[bytes]:
    return [a["blob"] for a in sorted(answers or [], key=lambda a: a["bucket"])]
