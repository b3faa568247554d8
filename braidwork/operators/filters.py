"""Row filters with their accounting. Conditions are Columns of the caller's; a null condition counts as false."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import ordinals


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def drop_on_error(df: DataFrame, made: dict[str, Column], strict: bool = False) -> DataFrame:
    """Adds columns that are null where they could not be made. Such rows go, or with strict make the query fail when it runs."""
    out = df.withColumns(made)
    failed = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in made])
    if strict:
        return out.filter(F.when(failed, F.raise_error(F.lit(f"a row has no {', '.join(made)}")).cast("boolean")).otherwise(True))
    return out.filter(~failed)


def rejected_differs(df: DataFrame, last: str, rejected: str) -> DataFrame:
    """Preference rows whose rejected response is there and is not the last message."""
    return df.filter(F.col(rejected).isNotNull() & ~F.col(rejected).eqNullSafe(F.col(last)))


def hard_successes(df: DataFrame, success: Column, hard: Column, copies: int, name: str = "copy") -> DataFrame:
    """Rows that succeeded and are hard, `copies` times each, numbered from 0."""
    return df.filter(_true(success) & _true(hard)).withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def first_reason(rules: list[tuple[str, Column]], kept: str = "kept") -> Column:
    """Name of the first rule that a row breaks; rules are conditions of breaking, in order."""
    out = F.lit(kept)
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def reject_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """reason, n: rows by the first rule they break."""
    return df.groupBy(first_reason(rules).alias("reason")).agg(F.count("*").alias("n"))


#: Fixed value: what a tool result shows where the call led nowhere.
DEAD_END = r"error|: [45]\d"


def dead_ends(calls: DataFrame, results: DataFrame, session: list[str], order: list[str], text: str, pattern: str = DEAD_END) -> DataFrame:
    """calls with `dead_end`: whether the result of the same place in the session shows an error. A call without a result is none."""
    place = F.row_number().over(Window.partitionBy(*session).orderBy(*order))
    own = results.select(*session, F.col(text).alias("_text"), place.alias("_k"))
    out = calls.withColumn("_k", place).join(own, [*session, "_k"], "left")
    return out.withColumn("dead_end", _true(F.lower("_text").rlike(pattern))).drop("_k", "_text")


def missing_by_path(df: DataFrame, paths: dict[str, Column]) -> DataFrame:
    """path, missing: rows in which a nested field is null."""
    return df.agg(*[F.count_if(c.isNull()).alias(n) for n, c in paths.items()]).unpivot([], list(paths), "path", "missing")


def required(df: DataFrame, paths: dict[str, Column]) -> DataFrame:
    """The rows that have every nested field."""
    return df.filter(reduce(lambda a, b: a & b, [c.isNotNull() for c in paths.values()]))


def place_ranges(spec: str, rows: int) -> list[tuple[int, int]]:
    """First and last place of each part of `0-4,7`; anything else, and places beyond the rows, are errors."""
    out = []
    for part in map(str.strip, spec.split(",")):
        if not re.fullmatch(r"\d+(-\d+)?", part):
            raise ValueError(f"no place: {part!r}")
        low, high = int(part.partition("-")[0]), int(part.rpartition("-")[2])
        if not low <= high < rows:
            raise ValueError(f"places {part} of {rows} rows")
        out.append((low, high))
    return out


def select_tasks(df: DataFrame, key: str, order: str, places: str | None = None, ids: list | None = None, most: int | None = None, unknown: str = "raise") -> DataFrame:
    """Rows by place in the order (an integer column; `0-4,7`), by ids, then the first `most` of them.

    Errors, found before anything runs: a key that two rows have, places beyond the rows, an unknown id (unless unknown="ignore"),
    most below 1, and a choice that is empty.
    """
    if most is not None and most < 1:
        raise ValueError("most is at least 1")
    rows, keys = df.agg(F.count("*"), F.count_distinct(key)).first()
    if rows != keys:
        raise ValueError(f"{rows - keys} repeated or null values of {key}")
    out = df
    if places:
        numbered = ordinals(df, [order, key], "_place", F.floor(F.col(order) / 65536))
        inside = reduce(lambda a, b: a | b, [F.col("_place").between(*r) for r in place_ranges(places, rows)])
        out = numbered.filter(inside).drop("_place")
    if ids:
        wanted = sorted(set(ids))
        if unknown == "raise" and (lost := sorted(set(wanted) - {r[0] for r in df.filter(F.col(key).isin(wanted)).select(key).collect()})):
            raise ValueError(f"unknown: {lost[:10]}")
        out = out.filter(F.col(key).isin(wanted))
    out = out if most is None else out.orderBy(order, key).limit(most)
    if out.isEmpty():
        raise ValueError("nothing selected")
    return out


def corrupt_excluded(df: DataFrame, known: DataFrame, key: str, flag: str, fallback: Column) -> DataFrame:
    """Rows that are not corrupt: by the flag (0 or 1) known of their key, else by the fallback condition."""
    flags = known.select(F.col(key).alias("_key"), F.col(flag).alias("_flag"))
    return df.join(flags, F.col(key) == F.col("_key"), "left").filter(~F.coalesce(F.col("_flag") != 0, _true(fallback))).drop("_key", "_flag")


def kept_and_dropped(df: DataFrame, keep: Column, kept: str = "kept", dropped: str = "dropped") -> DataFrame:
    """One row: how many rows a condition keeps and how many go."""
    return df.agg(F.count_if(_true(keep)).alias(kept), F.count_if(~_true(keep)).alias(dropped))


def has_text(*columns: str) -> Column:
    """Whether all columns hold more than white space."""
    return reduce(lambda a, b: a & b, [_true(F.length(F.trim(c)) > 0) for c in columns])


def exact_subset(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted keys; a key wanted twice, missing, or found twice makes the query fail when it runs."""
    found = df.join(wanted.select(key).distinct(), key, "left_semi")
    asked = wanted.agg(F.count("*").alias("_n"), F.count_distinct(key).alias("_d"))
    check = asked.crossJoin(found.agg(F.count("*").alias("_f"), F.count_distinct(key).alias("_u")))
    right = (F.col("_n") == F.col("_d")) & (F.col("_d") == F.col("_f")) & (F.col("_f") == F.col("_u"))
    ok = F.when(right, True).otherwise(F.raise_error(F.lit("missing or repeated keys")).cast("boolean"))
    return found.crossJoin(F.broadcast(check)).filter(ok).drop("_n", "_d", "_f", "_u")


def constant_groups(df: DataFrame, group: str, score: str) -> DataFrame:
    """group, n of the groups whose scores are all the same (one row, or no score, too): they teach nothing."""
    by = df.groupBy(group).agg(F.count("*").alias("n"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("_std"))
    return by.filter("_std = 0").drop("_std")
