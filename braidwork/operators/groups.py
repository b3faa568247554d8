"""Group-relative statistics and advantages. Sample deviations have ddof 1; a group of one has deviation 0 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import ordinals


def group_stats(df: DataFrame, group: str, value: str, eps: float = 1e-6) -> DataFrame:
    """Mean, deviation and count by group: variance floored at eps; a group of one has mean 0 and deviation 1."""
    n = F.count(value)
    out = df.groupBy(group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), n.alias("count"))
    one = F.col("count") <= 1
    return out.select(
        group,
        F.when(one, 0.0).otherwise(F.col("m")).alias("mean"),
        F.when(one, 1.0).otherwise(F.sqrt(F.greatest("v", F.lit(eps)))).alias("std"),
        "count",
    )


def group_codes(df: DataFrame, label: str, name: str = "code") -> DataFrame:
    """Adds a code: where all labels of the column are whole numbers, their strings, or within 1e-6 of whole numbers, that number; else
    every label is numbered in sorted order. Null labels have no code.

    Labels are numbered over their distinct values, in ranges whose edges are sampled from the labels, so no task orders all of them.
    """
    column, kind = F.col(label), dict(df.dtypes)[label]
    if kind in ("double", "float"):
        whole = F.when(F.abs(column - F.round(column)) <= 1e-6, F.round(column).cast("long"))
    else:
        whole = column.try_cast("long")
    distinct = df.filter(column.isNotNull()).select(column.alias("_label"), whole.alias("_whole")).distinct()
    all_whole = distinct.agg(F.coalesce(F.bool_and(F.col("_whole").isNotNull()), F.lit(True)).alias("_all"))
    ranked = ordinals(distinct, ["_label"], "_rank")
    ranked = ranked.withColumn("_rank", F.col("_rank").cast("long")).crossJoin(F.broadcast(all_whole))
    codes = ranked.select("_label", F.when(F.col("_all"), F.col("_whole")).otherwise(F.col("_rank")).alias(name))
    return df.join(codes, column == F.col("_label"), "left").drop("_label")


def weighted_reward(df: DataFrame, columns: list[str], weights: list[float], name: str = "reward") -> DataFrame:
    """The weighted sum of reward columns; null and NaN count as nothing."""
    total: Column = F.lit(0.0)
    for column, weight in zip(columns, weights):
        total = total + F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0)) * weight
    return df.withColumn(name, total)


def nan_to_null(column: str) -> Column:
    return F.when(~F.isnan(column), F.col(column))


def reward_metrics(df: DataFrame, group: str, reward: str, parts: list[str]) -> DataFrame:
    """One row: mean reward, mean deviation of groups, share of groups without deviation, mean and deviation of each part."""
    std = F.coalesce(F.stddev_samp(reward), F.lit(0.0))
    sums = [F.sum(reward).alias("s"), F.count(reward).alias("n"), std.alias("std")]
    for p in parts:
        x = nan_to_null(p)
        sums += [F.sum(x).alias(f"s_{p}"), F.sum(x * x).alias(f"q_{p}"), F.count(x).alias(f"n_{p}")]
    by = df.groupBy(group).agg(*sums)
    out = [
        (F.sum("s") / F.sum("n")).alias("reward_mean"),
        F.avg("std").alias("reward_std"),
        F.avg(F.when(F.col("std") < 1e-6, 1.0).otherwise(0.0)).alias("frac_zero_std"),
    ]
    for p in parts:
        n, s, q = F.sum(f"n_{p}"), F.sum(f"s_{p}"), F.sum(f"q_{p}")
        out += [(s / n).alias(f"{p}_mean"), F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))).alias(f"{p}_std")]
    return by.agg(*out)


def advantages(df: DataFrame, group: str, reward: str, estimator: str = "grpo", scale: str = "group") -> DataFrame:
    """Adds `advantage`. estimator: grpo, rloo or reinforce_plus_plus; scale: group, batch or none.

    Batch statistics come from a one-row aggregate joined back, not from a window over the whole table.
    """
    w = Window.partitionBy(group)
    mean, n = F.avg(reward).over(w), F.count(reward).over(w)
    raw = F.col(reward) - mean
    if estimator == "rloo":
        raw = F.when(n > 1, raw * n / (n - 1)).otherwise(raw)
    out = df.withColumn("advantage", raw)
    of = "advantage" if estimator == "reinforce_plus_plus" else reward
    if scale == "group":
        std = F.coalesce(F.stddev_samp(of).over(w), F.lit(0.0))
        return out.withColumn("advantage", F.col("advantage") / (std + 1e-4))
    if scale == "batch":
        std = out.agg(F.coalesce(F.stddev_samp(of), F.lit(0.0)).alias("_std"))
        return out.crossJoin(F.broadcast(std)).withColumn("advantage", F.col("advantage") / (F.col("_std") + 1e-4)).drop("_std")
    return out


def gdpo(df: DataFrame, group: str, parts: list[str], weights: list[float]) -> DataFrame:
    """Adds `advantage`: each part normalised in its group, weighted and summed, then normalised over all rows."""
    w, total = Window.partitionBy(group), F.lit(0.0)
    for p, weight in zip(parts, weights):
        x = nan_to_null(p)
        z = (x - F.avg(x).over(w)) / (F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)) + 1e-8)
        total = total + F.coalesce(z, F.lit(0.0)) * weight
    out = df.withColumn("_sum", total)
    all_ = out.agg(F.avg("_sum").alias("_m"), F.stddev_samp("_sum").alias("_s"))
    return out.crossJoin(F.broadcast(all_)).withColumn("advantage", (F.col("_sum") - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_sum", "_m", "_s")


def dynamic_group_advantages(df: DataFrame, request: str, prompt: str, reward: str, order: list[str]) -> DataFrame:
    """Adds `advantage`: the last row of each request stands for it, is normalised among its prompt's, and gives all its rows the result."""
    last = df.withColumn("_n", F.row_number().over(Window.partitionBy(request).orderBy(*[F.col(o).desc() for o in order]))).filter("_n = 1")
    scored = advantages(last.select(F.col(request).alias("_request"), prompt, reward), prompt, reward).select("_request", "advantage")
    return df.join(scored, F.col(request) == F.col("_request")).drop("_request")


def session_advantages(df: DataFrame, uid: str, session: str, index: str, reward: str) -> DataFrame:
    """Adds `advantage`: a session's last output is normalised among the sessions of its uid and broadcast to all outputs."""
    final = df.groupBy(uid, session).agg(F.max_by(reward, index).alias("_final"))
    scored = advantages(final, uid, "_final").select(F.col(uid).alias("_u"), F.col(session).alias("_s"), "advantage")
    return df.join(scored, (F.col(uid) == F.col("_u")) & (F.col(session) == F.col("_s"))).drop("_u", "_s")


def token_advantages(df: DataFrame, advantage: str, student: str, teacher: str, beta: float) -> DataFrame:
    """Adds per-token arrays: `token_advantage` = advantage + beta * (teacher - student), and `k3` = exp(d) - d - 1 with d = teacher - student."""
    d = F.zip_with(student, teacher, lambda s, t: t - s)
    return df.withColumn("token_advantage", F.transform(d, lambda x: F.col(advantage) + beta * x)).withColumn("k3", F.transform(d, lambda x: F.exp(x) - x - 1))


def discounted(df: DataFrame, episode: str, order: list[str], total: Column, gamma: float) -> DataFrame:
    """Adds `step_reward` = gamma ** (steps after this one) * the episode's reward."""
    w = Window.partitionBy(episode)
    after = F.count("*").over(w) - F.row_number().over(w.orderBy(*order))
    return df.withColumn("step_reward", F.pow(F.lit(gamma), after) * total)


def min_max(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds `normalised` = (x - min) / (max - min + 1e-5) in its group; a constant group has min(1, x)."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    x = F.col(value)
    return df.withColumn("normalised", F.when(low == high, F.least(F.lit(1.0), x)).otherwise((x - low) / (high - low + 1e-5)))
