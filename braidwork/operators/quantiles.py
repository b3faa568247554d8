"""Exact ranks and percentiles of a column without a task that holds all its values.

Rows are counted by value in one pass, and the counts written. Where the distinct values are few one task orders them; else they are dealt
to ranges by a sample of themselves, each range is ordered by itself, and moved by the rows in the ranges before it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.sources.shared import new_path

from .sampling import RANGE_ROWS, ranged


def value_counts(df: DataFrame, value: str, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """value, n (rows that have it), before (rows with a smaller one); null values are left out."""
    path = new_path(df.sparkSession, "values")
    df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("n")).write.parquet(path)
    by = ranged(df.sparkSession.read.parquet(path), ["_v"], "_range", rows_per_range)
    per = by.groupBy("_range").agg(F.sum("n").alias("_c"))
    start = F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = by.withColumn("_inside", inside).join(F.broadcast(per.select("_range", start.alias("_start"))), "_range")
    return out.select(F.col("_v").alias(value), "n", (F.col("_start") + F.col("_inside")).alias("before"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Percentiles with linear interpolation between neighbours; null without rows."""
    counts = value_counts(df, value)
    rows = counts.agg(F.sum("n")).first()[0]
    if not rows:
        return [None] * len(shares)
    places = [p * (rows - 1) for p in shares]
    wanted = sorted({x for p in places for x in (math.floor(p), math.ceil(p))})
    hit = lambda r: (F.col("before") <= r) & (F.col("before") + F.col("n") > r)
    found = counts.filter(reduce(lambda a, b: a | b, map(hit, wanted))).collect()
    at = {r: float(next(x[value] for x in found if x["before"] <= r < x["before"] + x["n"])) for r in wanted}
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """value and its rank from 1; equal values share the mean of their places."""
    return value_counts(df, value).select(value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
