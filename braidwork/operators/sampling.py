"""Sampling, splits, mixing and sharding, all by hash order: `md5(seed || key)` with the key as tiebreak.

A global order is needed only where an exact number of rows is asked for; there the k-th hash is found by a top-k
(`orderBy.limit`), which each task answers with k rows, or by counts of hash ranges, and no task sorts the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.sources.shared import new_path


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


#: Rows that one task puts in order, about.
RANGE_ROWS = 1 << 20


def ranged(df: DataFrame, order: list[str], name: str = "_b", rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Adds the number of the range of the order that a row lies in: as many ranges as rows ask for, with edges from a sample of the order itself.

    Where one range is enough nothing is moved; else rows are written as they were dealt, since a second sample could deal them otherwise. Rows that
    are equal in all of the order's columns lie in one range.
    """
    n = -(-df.count() // rows_per_range)
    if n <= 1:
        return df.withColumn(name, F.lit(0))
    path = new_path(df.sparkSession, "ranges")
    df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ordinals(df: DataFrame, order: list[str | Column], name: str = "ordinal", buckets: Column | None = None, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Adds the row's place, from 0, in a total order of all rows.

    Rows are dealt by the order's range; each range is numbered by itself and moved by the rows before it, and no single task orders all.
    `buckets` may name the leading part of the order where it is known to part the rows evenly; else ranges are sampled.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(cols)])
    names = [f"_o{i}" for i in range(len(cols))]
    keyed = ranged(keyed, names, "_b", rows_per_range) if buckets is None else keyed.withColumn("_b", buckets)
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_c"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(*names)) - 1
    return keyed.withColumn("_n", inner).join(before, "_b").withColumn(name, F.col("_n") + F.col("_before")).drop("_b", "_n", "_before", *names)


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "ordinal") -> DataFrame:
    """Adds the place of each row in hash order. Hashes are even, so their first four digits part them to 65,536 ranges without a sample."""
    h = hash_order(key, seed)
    return ordinals(df, [h, key], name, F.substring(h, 1, 4))


def sample_repeating(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows: every row n // rows times, and the first n % rows in hash order once more. Adds `copy`."""
    total = df.agg(F.count("*").alias("_total"))
    rows = shuffled(df, key, seed, "_at").crossJoin(F.broadcast(total))
    copies = F.floor(F.lit(n) / F.col("_total")) + F.when(F.col("_at") < F.lit(n) % F.col("_total"), 1).otherwise(0)
    return rows.withColumn("_k", copies).filter("_k > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).drop("_at", "_total", "_k")


def split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds `part`: val for the first max(int(rows * ratio), 1) rows in hash order (none at ratio 0), else train."""
    if ratio == 0:
        return df.withColumn("part", F.lit("train"))
    if ratio == 1:
        return df.withColumn("part", F.lit("val"))
    total = df.agg(F.greatest(F.floor(F.count("*") * ratio), F.lit(1)).alias("_val"))
    rows = shuffled(df, key, seed, "_at").crossJoin(F.broadcast(total))
    return rows.withColumn("part", F.when(F.col("_at") < F.col("_val"), "val").otherwise("train")).drop("_at", "_val")


#: Slots pick their source by so many equal parts of the whole.
PARTS = 1_000_000


def _picked(slots: DataFrame, seed: int, shares: list[float]) -> DataFrame:
    """Adds `source`: the one in whose share of [0, 1) the slot's hash falls."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("slot").cast("string")))
    u = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(PARTS)) / PARTS
    source = F.lit(len(shares) - 1)
    for i in reversed(range(len(shares) - 1)):
        source = F.when(u < sum(shares[: i + 1]), i).otherwise(source)
    return slots.withColumn("source", source)


def interleave(parts: list[tuple[DataFrame, float]], key: str, seed: int = 42, until: str = "first") -> DataFrame:
    """Rows of several sources in one order: slot s goes to the source that hash(seed, s) picks by probability.

    A source's k-th slot has its k-th row in order of key. `first`: slots end when a source is used up; `all`: they go on until every
    source is through, those used up beginning again. Adds `source` and `slot`. Slots are made until that point is among
    them, twice as many each time, so no row is lost however small a probability; one that no slot can pick is refused.
    """
    spark, shares = parts[0][0].sparkSession, [p for _, p in parts]
    if until not in ("first", "all"):
        raise ValueError("until is first or all")
    if min(shares) * PARTS < 1 or abs(sum(shares) - 1) > 1e-9:
        raise ValueError(f"probabilities are at least 1 / {PARTS} and sum to 1")
    numbered = [shuffled(df, key, seed + i, "_k").withColumn("source", F.lit(i)) for i, (df, _) in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, numbered)
    sizes = {r[0]: r[1] for r in rows.groupBy("source").count().collect()}
    if len(sizes) < len(parts):
        return rows.limit(0).withColumn("slot", F.lit(0).cast("long")).drop("_k")
    due = [int(sizes[i] / p * 1.2) + 1000 for i, p in enumerate(shares)]
    need = min(due) if until == "first" else max(due)
    while True:
        slots = _picked(spark.range(need).withColumnRenamed("id", "slot"), seed, shares)
        had = {r[0]: r[1] for r in slots.groupBy("source").count().collect()}
        through = [had.get(i, 0) >= n for i, n in sizes.items()]
        if any(through) if until == "first" else all(through):
            break
        need *= 2
    # the place of a slot among its source's: by blocks of slots, each a small window, moved by the blocks before
    block = F.floor(F.col("slot") / 65536)
    per = slots.groupBy("source", block.alias("_b")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("source", "_b", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("source", "_b").orderBy("slot")) - 1
    slots = slots.withColumn("_b", block).withColumn("_i", inner).join(per, ["source", "_b"]).withColumn("_k", F.col("_i") + F.col("_before")).drop("_b", "_i", "_before")
    size = F.element_at(F.create_map(*[x for i, n in sizes.items() for x in (F.lit(i), F.lit(n))]), F.col("source"))
    slots = slots.withColumn("_size", size.cast("long"))
    ends = slots.filter("_k = _size - 1").agg((F.min("slot") if until == "first" else F.max("slot")).alias("_last"))
    slots = slots.crossJoin(F.broadcast(ends)).filter("slot <= _last")
    return slots.withColumn("_k", F.pmod("_k", "_size")).drop("_size", "_last").join(rows, ["source", "_k"]).drop("_k")


def shards(df: DataFrame, ordinal: str, world: int, batch: int, drop_last: bool = True) -> DataFrame:
    """Adds `rank` and `batch` of rank-strided sharding; with drop_last, incomplete batches of a rank go."""
    rows = df.withColumn("rank", F.pmod(F.col(ordinal), F.lit(world))).withColumn("batch", F.floor(F.floor(F.col(ordinal) / world) / batch))
    if not drop_last:
        return rows
    full = rows.groupBy("rank", "batch").agg(F.count("*").alias("_c")).filter(F.col("_c") == batch).drop("_c")
    return rows.join(full, ["rank", "batch"], "left_semi")


def length_grouped(df: DataFrame, key: str, length: str, batch: int, seed: int = 42, most: int = 50) -> DataFrame:
    """Adds `ordinal`, an order for shards() in which batches (of all ranks together) hold rows of like length.

    Rows in hash order are cut to mega-batches of up to `most` batches, at least four of which the table holds if it can; within each
    the longest come first. The longest of all changes places with the first row, so that memory runs out at once or never.
    """
    rows = shuffled(df, key, seed, "_at")
    size = df.agg((F.greatest(F.least(F.floor(F.count("*") / (4 * batch)), F.lit(most)), F.lit(1)) * batch).alias("_size"))
    rows = rows.crossJoin(F.broadcast(size)).withColumn("_mega", F.floor(F.col("_at") / F.col("_size")))
    place = F.row_number().over(Window.partitionBy("_mega").orderBy(F.col(length).desc(), "_at")) - 1
    rows = rows.withColumn("_n", F.col("_mega") * F.col("_size") + place)
    longest = rows.agg(F.max_by("_n", F.struct(F.col(length), -F.col("_n"))).alias("_longest"))
    moved = F.when(F.col("_n") == F.col("_longest"), 0).when(F.col("_n") == 0, F.col("_longest")).otherwise(F.col("_n"))
    return rows.crossJoin(F.broadcast(longest)).withColumn("ordinal", moved).drop("_at", "_mega", "_size", "_n", "_longest")


def held_out(df: DataFrame, excluded: DataFrame, keys: list[str], group: str, order: list[str | Column], most: int) -> DataFrame:
    """One row of each group that isn't excluded, for at most `most` groups in order."""
    free = df.join(excluded, keys, "left_anti")
    one = free.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_n = 1").drop("_n")
    return one.orderBy(group).limit(most)


def round_robin(df: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Adds `turn` (the row's place in its prefix) and `prefix_order` (the first row of the prefix): sorting by both interleaves."""
    w = Window.partitionBy(prefix)
    return df.withColumn("turn", F.row_number().over(w.orderBy(*order))).withColumn("prefix_order", F.min(order[0]).over(w))
