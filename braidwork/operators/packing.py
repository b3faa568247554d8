"""Packing and balancing. Sequential folds run per shard, a group of bounded size; within a shard the order is that of the ordinal."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_fit(lengths: list[int], capacity: int) -> list[int]:
    """Pack number of each item: a pack is closed when the next item doesn't fit or when it is full."""
    out, pack, held, some = [], 0, 0, False
    for n in lengths:
        if some and held + n > capacity:
            pack, held = pack + 1, 0
        out.append(pack)
        held, some = held + n, True
        if held >= capacity:
            pack, held, some = pack + 1, 0, False
    return out


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each item, longest first, into the fullest bin that it fits; an item over the capacity has a bin of its own."""
    import bisect

    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out, room, bins = [0] * len(lengths), [], 0
    for i in order:
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, bins = capacity, bins, bins + 1
        out[i] = b
        if left - lengths[i] > 0:
            bisect.insort(room, (left - lengths[i], b))
    return out


#: Items that are packed together, and in a stream.
BATCH_ITEMS, STREAM_ITEMS = 1000, 128


def batched(lengths: list[int], capacity: int, batch: int = BATCH_ITEMS, strategy: str = "binpack") -> list[int]:
    """Pack number of each item of a shard. Items come in batches; the last pack of a batch stays open and is packed anew with the next.

    `binpack`: best fit, longest first; `sequential`: next fit in order.
    """
    if strategy not in ("binpack", "sequential"):
        raise ValueError("strategy is binpack or sequential")
    if strategy == "sequential":  # an open pack that is carried goes on as if there were no batches
        return next_fit(lengths, capacity)
    out, packs, held = [0] * len(lengths), 0, []
    for begin in range(0, len(lengths), batch):
        held += range(begin, min(begin + batch, len(lengths)))
        bins = best_fit([lengths[i] for i in held], capacity)
        finished = begin + batch >= len(lengths)
        done = max(bins) + 1 if finished else max(bins)  # bins are numbered as they were opened; the last is carried
        for i, b in zip(held, bins):
            out[i] = packs + b
        held, packs = [i for i, b in zip(held, bins) if b >= done], packs + done
    return out


def cyclic(lengths: list[int], capacity: int, packs: int, batch: int = STREAM_ITEMS) -> list[list[int]]:
    """The first `packs` packs of items that begin again when they are through: places of each pack's items. Empty for no items."""
    out: list[list[int]] = []
    held, at = [], 0
    while lengths and len(out) < packs:
        held += [(at + i) % len(lengths) for i in range(batch)]
        at = (at + batch) % len(lengths)
        bins = best_fit([lengths[i] for i in held], capacity)
        last = max(bins)
        out += [[i for i, b in zip(held, bins) if b == j] for j in range(last)]
        held = [i for i, b in zip(held, bins) if b == last]
    return out[:packs]


def cyclic_packs(df: DataFrame, shard: Column, ordinal: str, value: str, capacity: int, packs: int, batch: int = STREAM_ITEMS) -> DataFrame:
    """shard, pack, slot, ordinal, value: the first `packs` packs of each shard's rows in order, which begin again when they are through; by one task a shard."""
    rows = df.select(shard.cast("long").alias("shard"), F.col(ordinal).cast("long").alias("ordinal"), F.col(value).cast("long").alias("value"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("ordinal")
        made = cyclic(t["value"].to_pylist(), capacity, packs, batch)
        rows = [(p, s, i) for p, pack in enumerate(made) for s, i in enumerate(pack)]
        taken = t.take(pa.array([i for _, _, i in rows], pa.int64()))
        return taken.append_column("pack", pa.array([p for p, _, _ in rows], pa.int64())).append_column("slot", pa.array([s for _, s, _ in rows], pa.int64()))

    return rows.groupBy("shard").applyInArrow(run, "shard long, ordinal long, value long, pack long, slot long")


def greedy(values: list[int], k: int, equal_size: bool = False) -> list[int]:
    """Partition of each value, in order: the one with the smallest sum, of equal ones the first."""
    bias = sum(values) + 1 if equal_size else 0
    heap, out = [(0, j) for j in range(k)], []
    for v in values:
        total, j = heapq.heappop(heap)
        out.append(j)
        heapq.heappush(heap, (total + v + bias, j))
    return out


def differencing(values: list[int], k: int, equal_size: bool = False) -> list[int]:
    """Partition of each value by k-way largest differencing: the two states of widest spread merge, largest parts with smallest."""
    if len(values) < k or equal_size and len(values) % k:
        raise ValueError("too few values, or not a multiple of the partitions")
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    if equal_size:
        starts = [[([order[at + j]], values[order[at + j]]) for j in range(k)] for at in range(0, len(order), k)]
    else:
        starts = [[([i], values[i])] + [([], 0)] * (k - 1) for i in order]

    def state(parts):
        parts = sorted(parts, key=lambda p: (-p[1], -len(p[0]), p[0]))
        return (-(parts[0][1] - parts[-1][1]), next(count), parts)

    from itertools import count as counter

    count = counter()
    heap = [state(s) for s in starts]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        heapq.heappush(heap, state([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]))
    out = [0] * len(values)
    for j, (members, _) in enumerate(heap[0][2]):
        for i in members:
            out[i] = j
    return out


def balanced(values: list[int], k: int, equal_size: bool = False) -> list[int]:
    """Partition of each value by differencing; every partition has a value, and with equal_size as many as the others, or ValueError."""
    out = differencing(values, k, equal_size)
    sizes = np.bincount(out, minlength=k)
    if len(sizes) != k or not sizes.all() or (equal_size and len(set(sizes.tolist())) != 1):
        raise ValueError("a partition is empty, or sizes differ")
    return out


def workload(n: Column) -> Column:
    return 24576 * n + n * n


def by_shard(df: DataFrame, shard: Column, ordinal: str, value: str, fold: Callable[[list[int]], list[int]], name: str = "pack") -> DataFrame:
    """shard, ordinal, value and fold's number of each row; a shard is folded in order of the ordinal by one task."""
    rows = df.select(shard.cast("long").alias("shard"), F.col(ordinal).cast("long").alias("ordinal"), F.col(value).cast("long").alias("value"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("ordinal")
        return t.append_column(name, pa.array(fold(t["value"].to_pylist()), pa.int64()))

    return rows.groupBy("shard").applyInArrow(run, f"shard long, ordinal long, value long, {name} long")


def equal_parts(df: DataFrame, shard: Column, ordinal: str, value: str, k: int) -> DataFrame:
    """shard, ordinal, value, is_padding, part: each shard in k partitions of equally many places by differencing.

    A shard whose rows are no multiple of k is filled up with copies of its largest row (of equal ones the last), which are marked:
    they take a place and weigh as much as that row, but are no rows of the table.
    """
    rows = df.select(shard.cast("long").alias("shard"), F.col(ordinal).cast("long").alias("ordinal"), F.col(value).cast("long").alias("value"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("ordinal")
        values = t["value"].to_pylist()
        largest = max(range(len(values)), key=lambda i: (values[i], i))
        places = [*range(len(values)), *[largest] * (-len(values) % k)]
        out = t.take(pa.array(places, pa.int64())).append_column("is_padding", pa.array([i >= len(values) for i in range(len(places))]))
        return out.append_column("part", pa.array(balanced([values[i] for i in places], k, True), pa.int64()))

    return rows.groupBy("shard").applyInArrow(run, "shard long, ordinal long, value long, is_padding boolean, part long")


def least_divisor(n: int) -> int:
    """The least number above one that divides n; n itself where it is prime, one for one."""
    return next((d for d in range(2, int(n**0.5) + 1) if n % d == 0), max(n, 1))


def uid_partitions(df: DataFrame, batch: Column, uid: str, ordinal: str, length: str, k: int | Callable[[int], int]) -> DataFrame:
    """shard, uid, workload, part: the groups of a batch in k partitions of equally many groups and about equal workload.

    A group's rows, of one uid, stay together; its workload is the sum of theirs, its place that of its first row. k may be a function of
    the number of groups. A batch whose groups are no multiple of k fails.
    """
    load = F.sum(workload(F.col(length).cast("long")))
    by = df.groupBy(batch.cast("long").alias("shard"), F.col(uid).alias("uid")).agg(F.min(ordinal).alias("_first"), load.alias("_load"))
    parts = by_shard(by, F.col("shard"), "_first", "_load", lambda x: balanced(x, k(len(x)) if callable(k) else k, True), "part")
    return by.join(parts, (by["shard"] == parts["shard"]) & (by["_first"] == parts["ordinal"])).select(by["shard"], "uid", parts["value"].alias("workload"), "part")


def arranged(df: DataFrame, shard: str, part: str, ordinal: str) -> DataFrame:
    """Adds `position`: the row's place in its shard when partitions stand one after the other, rows in order within."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(shard).orderBy(part, ordinal)) - 1)


def restored(df: DataFrame, shard: str, ordinal: str, position: str = "position") -> DataFrame:
    """Adds `source`: for each place of the original order, the position to take the row from (the inverse of the arrangement).

    df has a row for each position, with the ordinal of the row that went there.
    """
    place = F.row_number().over(Window.partitionBy(shard).orderBy(ordinal)) - 1
    return df.withColumn("place", place).withColumnRenamed(position, "source")


def centre_out(loads: list[int]) -> list[int]:
    """Place of each batch when the largest stand in the middle and the smallest first and last."""
    big_first = sorted(range(len(loads)), key=lambda j: (-loads[j], j))
    order = big_first[::2][::-1] + big_first[1::2]
    out = [0] * len(loads)
    for place, j in enumerate(order):
        out[j] = place
    return out


def micro_count(rows: int, total: int, most: int, divided_by: int = 1) -> int:
    """Micro-batches of at most `most` on average, no more than rows, rounded up to a multiple where rows allow."""
    n = min(rows, -(-total // most))
    return max(1, min(rows, -(-n // divided_by) * divided_by))


def micro_batches(df: DataFrame, group: str, ordinal: str, length: str, most: int, divided_by: int = 1) -> DataFrame:
    """Rows of each batch in micro-batches of about equal workload, numbered so that small ones stand first and last."""

    def fold(lengths: list[int]) -> list[int]:
        n = micro_count(len(lengths), sum(lengths), most, divided_by)
        loads = [24576 * x + x * x for x in lengths]
        part = differencing(loads, n)
        place = centre_out(np.bincount(part, weights=loads, minlength=n).tolist())
        return [place[j] for j in part]

    return by_shard(df, F.col(group), ordinal, length, fold, "micro")


#: Fixed value: bounds of token bins, in units of 1024.
BIN_KS = (4, 8, 16, 32, 64)


def token_bin(n: Column) -> Column:
    """Name of the smallest bin that holds n tokens: 4K, 8K .. 64K, else 128K."""
    out = F.lit("128K")
    for k in reversed(BIN_KS):
        out = F.when(n <= k * 1024, f"{k}K").otherwise(out)
    return out


def padded(df: DataFrame, multiple: int, ordinal: str) -> DataFrame:
    """Adds `is_padding`, and copies of the first rows in order until the number of rows is a multiple. At most `multiple` - 1 rows are added."""
    total = df.agg(F.count("*").alias("_n"))
    first = df.orderBy(ordinal).limit(multiple - 1) if multiple > 1 else df.limit(0)
    first = first.withColumn("_i", F.row_number().over(Window.orderBy(ordinal))).crossJoin(F.broadcast(total))
    short = F.pmod(-F.col("_n"), F.lit(multiple))
    extra = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((short - F.col("_i") + 1) / F.least(F.col("_n"), F.lit(max(multiple - 1, 1)))) - 1, F.lit(-1)).cast("int"), F.lit(1)))
    fill = first.filter(F.col("_i") <= short).withColumn("_k", extra).drop("_k", "_i", "_n").withColumn("is_padding", F.lit(True))
    return df.withColumn("is_padding", F.lit(False)).unionByName(fill)


def fixed_length(ids: Column, n: int, pad: int) -> Column:
    """Cut or right-padded to n."""
    return F.concat(F.slice(ids, F.lit(1), F.lit(n)), F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(ids), F.lit(0))))
