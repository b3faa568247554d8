"""Joins with stated duplicate rules, set operations, interval and page operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: of several the last in the order."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def attach_last(left: DataFrame, right: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """Adds the last non-null value of right in its order, or null."""
    some = right.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(name))
    return left.join(some, keys, "left")


def retry_plan(tasks: DataFrame, samples: int, done: DataFrame, key: str) -> DataFrame:
    """(key, sample) that are missing in done or ended in an error. done: (key, sample, error)."""
    wanted = tasks.select(key, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    return wanted.join(done.filter("error is null").select(key, "sample"), [key, "sample"], "left_anti")


def checked_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a and b; a key that both have makes the query fail when it runs."""
    shared = a.select(key).join(b.select(key), key, "left_semi").agg(F.count("*").alias("_n"))
    both = a.unionByName(b).crossJoin(F.broadcast(shared))
    ok = F.when(F.col("_n") == 0, True).otherwise(F.raise_error(F.lit("the tables share keys")).cast("boolean"))
    return both.filter(ok).drop("_n")


def overlapping(df: DataFrame, start: str, end: str, low, high) -> DataFrame:
    """Rows whose [start, end) meets [low, high)."""
    return df.filter((F.col(start) < F.lit(high)) & (F.col(end) > F.lit(low)))


def clipped(df: DataFrame, start: str, end: str, low, high) -> DataFrame:
    return overlapping(df, start, end, low, high).withColumn(start, F.greatest(F.col(start), F.lit(low))).withColumn(end, F.least(F.col(end), F.lit(high)))


def merged_periods(df: DataFrame, group: str, start: str, end: str, width: int = 7 * 86_400) -> DataFrame:
    """Periods of a group joined where they overlap or touch: a new one begins where start lies beyond every end before.

    Periods that begin within the same `width` seconds (units, for plain numbers) are joined first, so that a group with very many is not one task's work:
    what is left for the last step is a row a gap.
    """

    def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(start, end)
        before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
        rows = rows.withColumn("_island", F.sum("_new").over(w))
        return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")

    at = {"timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(F.col(c).cast("timestamp")), "date": F.unix_date}.get(kind := dict(df.dtypes)[start], F.col)(start)
    slot = F.floor(at / F.lit(width * 1_000_000 if kind.startswith("timestamp") else max(1, width // 86_400) if kind == "date" else width))
    return joined(joined(df.select(group, start, end, slot.alias("_slot")), [group, "_slot"]), [group])


def page(df: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """A page of rows with `has_more`: one row beyond the page is looked at, so no count of the table is needed."""
    seen = df.orderBy(*order).offset(offset).limit(limit + 1)
    more = seen.agg((F.count("*") > limit).alias("has_more"))
    return seen.orderBy(*order).limit(limit).crossJoin(F.broadcast(more))


def changed_since(df: DataFrame, updated: str, deleted: str, token=None) -> DataFrame:
    """With a token, all rows changed after it, deleted ones too; without, all rows that are not deleted."""
    return df.filter(F.col(updated) > F.lit(token)) if token is not None else df.filter(~F.col(deleted))


#: Access roles from least to most.
ROLES = ["freeBusyReader", "reader", "writer", "owner"]


def role_rank(role: Column) -> Column:
    return F.coalesce(*[F.when(role == r, F.lit(i)) for i, r in enumerate(ROLES)], F.lit(-1))


def _cells(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Adds `_from` and `_upto`: the first slot of a period that isn't empty, and the one behind its last."""
    size = F.lit(width * 1_000_000)
    rows = df.filter(F.col(start) < F.col(end))
    return rows.withColumns({"_from": F.floor(F.unix_micros(start) / size), "_upto": F.floor((F.unix_micros(end) - 1) / size) + 1})


def dyadic_cover(first: str, upto: str, levels: int) -> Column:
    """The fewest dyadic slots that make up the slots [first, upto), as an array of structs (level, number): two a level at most, none overlapping.

    At the level of slots of 2^level, those left are [lo, hi); the first counts where it is a right half, and the last where it is a left
    half and not gone already, as neither is part of a slot of the next level that lies within.
    """
    lo, hi = f"-shiftright(-{first}, l)", f"shiftright({upto}, l)"
    return F.expr(f"""flatten(transform(sequence(0, {levels}), l -> concat(
      if({lo} < {hi} and ({lo} & 1) = 1, array(named_struct('level', l, 'number', {lo})), array()),
      if({lo} < {hi} and ({hi} & 1) = 1, array(named_struct('level', l, 'number', {hi} - 1)), array()))))""")


def overlap_join(a: DataFrame, b: DataFrame, start: str, end: str, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose [start, end) overlap, and whose columns `on` are equal. b's columns come with the prefix `b_`; empty periods have no pair.

    One of two that overlap begins within the other, so it is enough to join beginnings with periods, either way. A period is the dyadic
    slots that make it up, at most two a level, however long it is; a beginning is one slot of each level up to that of the longest
    period. `width` is the smallest slot, in seconds. Slots of a period don't overlap, so a pair is made once.
    """
    right = b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    sides = [(_cells(a, start, end, width), start, end), (_cells(right, f"b_{start}", f"b_{end}", width), f"b_{start}", f"b_{end}")]

    def within(inner: int, strictly: bool) -> DataFrame:
        """Pairs in which the row of the inner side begins within the other's period."""
        (points, p, _), (periods, s, e) = sides[inner], sides[1 - inner]
        longest = periods.agg(F.max(F.col("_upto") - F.col("_from"))).first()[0] or 1
        levels = int(longest).bit_length()
        covered = periods.withColumn("_slot", F.explode(dyadic_cover("_from", "_upto", levels))).select("*", F.col("_slot.level").alias("_level"), F.col("_slot.number").alias("_number")).drop("_slot", "_from", "_upto")
        begun = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_number", F.expr("shiftright(_from, _level)")).drop("_from", "_upto")
        names = {f"{c}": f"_p{c}" for c in ("_level", "_number")}
        equal = (F.col("_level") == F.col("_p_level")) & (F.col("_number") == F.col("_p_number"))
        for c in on:
            equal = equal & (F.col(c) == F.col(f"b_{c}"))
        begins = (F.col(p) > F.col(s) if strictly else F.col(p) >= F.col(s)) & (F.col(p) < F.col(e))
        return begun.withColumnsRenamed(names).join(covered, equal & begins).select(*a.columns, *right.columns)

    return within(1, False).unionByName(within(0, True))
