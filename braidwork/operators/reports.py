"""Evaluation roll-ups and reports: each takes the table, the names of its columns, and conditions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds; rows where it is null don't count."""
    return F.avg(condition.cast("double"))


def mean_by_source(df: DataFrame, source: str, scores: str) -> DataFrame:
    """source, score: mean over rows of the mean of each row's scores; rows without scores don't count."""
    own = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    return df.groupBy(source).agg(F.avg(own).alias("score"))


def episode_report(df: DataFrame, group: str, reward: str, passed: Column, early: Column, advice: Column) -> DataFrame:
    """By group: episodes, pass_rate, avg_reward, early_exits, with_advice, and the mean reward with advice and without."""
    v = F.col(reward)
    return df.groupBy(group).agg(
        F.count("*").alias("episodes"),
        share(passed).alias("pass_rate"),
        F.avg(v).alias("avg_reward"),
        F.count_if(early).alias("early_exits"),
        F.count_if(advice).alias("with_advice"),
        F.avg(F.when(advice, v)).alias("avg_with"),
        F.avg(F.when(~advice, v)).alias("avg_without"),
    )


def accuracy_by(df: DataFrame, groups: list[str], right: Column) -> DataFrame:
    """n and accuracy by each of the groups, and over all; a group's other columns are null."""
    return df.groupingSets([[g] for g in groups] + [[]], *groups).agg(F.count("*").alias("n"), share(right).alias("accuracy"))


def qa_summary(df: DataFrame, kind: str, em: str, f1: str, judge: str, least: float = 0.5) -> DataFrame:
    """By type and overall: n, means of EM, F1 and judge scores, and the share judged right. Within a type rows without F1 don't count, overall they count 0."""
    one = [F.avg(judge).alias("judge"), share(F.col(judge) >= least).alias("accuracy")]
    by = df.groupBy(kind).agg(F.count("*").alias("n"), F.avg(em).alias("em"), F.coalesce(F.avg(f1), F.lit(0.0)).alias("f1"), *one)
    whole = df.agg(F.lit("overall").alias(kind), F.count("*").alias("n"), F.avg(em).alias("em"), F.avg(F.coalesce(f1, F.lit(0.0))).alias("f1"), *one)
    return by.unionByName(whole)


def difficulty(df: DataFrame, task: str, score: str) -> DataFrame:
    """One row: mean, variance, standard deviation (population) and their ratio, of the tasks' mean scores."""
    a = df.groupBy(task).agg(F.avg(score).alias("_a"))
    std = F.stddev_pop("_a")
    return a.agg(F.avg("_a").alias("mean"), F.var_pop("_a").alias("variance"), std.alias("std"), (std / F.nullif(F.avg("_a"), F.lit(0.0))).alias("cv"))


def binned(value: Column, bins: list[tuple[float, str]], beyond: str) -> Column:
    """Name of the first bin whose bound the value is below; `beyond` for others and nulls."""
    out = F.lit(beyond)
    for bound, name in reversed(bins):
        out = F.when(value < bound, name).otherwise(out)
    return out


def stats_by(df: DataFrame, kind: str, bin_: str, value: str) -> DataFrame:
    """n, min, max and avg by type, by bin, by both and over all."""
    return df.cube(kind, bin_).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))


def array_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """By group: mean, population standard deviation, min, max and size of a column."""
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("size"))


def suite_table(df: DataFrame, suite: str, passed: Column, limited: Column, failed: Column, tokens: Column) -> DataFrame:
    """By suite: n, passed, pass_at_1, rows stopped by length, rows in error, and mean tokens of the rows that have them."""
    return df.groupBy(suite).agg(
        F.count("*").alias("n"),
        F.count_if(passed).alias("passed"),
        share(F.coalesce(passed, F.lit(False))).alias("pass_at_1"),
        F.count_if(limited).alias("length_limit"),
        F.count_if(failed).alias("errors"),
        F.avg(tokens).alias("mean_tokens"),
    )


def speed_comparison(df: DataFrame, run: str, seconds: str, tokens: str, base) -> DataFrame:
    """By run: mean and median seconds, rows an hour, tokens a second, and the mean against that of the run `base`."""
    s = df.groupBy(run).agg(
        F.avg(seconds).alias("mean"),
        F.median(seconds).alias("median"),
        (F.count("*") * 3600 / F.sum(seconds)).alias("per_hour"),
        (F.sum(tokens) / F.sum(seconds)).alias("tokens_s"),
    )
    of = df.filter(F.col(run) == base).agg(F.avg(seconds).alias("_base"))
    return s.crossJoin(F.broadcast(of)).withColumn("ratio", F.col("mean") / F.col("_base")).drop("_base")


def score_delta(df: DataFrame, suite: str, version: str, right: Column, name: str = "delta_pp") -> DataFrame:
    """Percentage points by which a suite's share of right rows rose since the version before (an integer less by 1)."""
    now = df.groupBy(suite, version).agg((share(right) * 100).alias("_now"))
    before = now.select(suite, (F.col(version) + 1).alias(version), F.col("_now").alias("_old"))
    return now.join(before, [suite, version]).select(suite, version, (F.col("_now") - F.col("_old")).alias(name))


def cluster_profile(df: DataFrame, cluster: str, value: str, most: int = 10) -> DataFrame:
    """The most frequent values of each cluster with n, rank and the cluster's size; of equal ones the smaller first."""
    c = df.groupBy(cluster, value).agg(F.count("*").alias("n"))
    size = df.groupBy(cluster).agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("n").desc(), value))
    return c.withColumn("rank", rank).filter(F.col("rank") <= most).join(size, cluster)


def manifest_stats(df: DataFrame, split: str, functional: Column, length: str) -> DataFrame:
    """By split: rows, how many test functions and how many standard input, and min, max and mean length."""
    return df.groupBy(split).agg(
        F.count("*").alias("rows"), F.count_if(functional).alias("functional"), F.count_if(~functional).alias("stdin"), F.min(length).alias("min"), F.max(length).alias("max"), F.avg(length).alias("mean")
    )


def merged_drops(df: DataFrame, group: str, dropped: str, value: str) -> DataFrame:
    """By group, over steps: samples dropped, and their staleness: mean weighted by what each step dropped (plain where none was), max and min."""
    n, v = F.col(dropped), F.col(value)
    mean = F.coalesce(F.sum(v * n) / F.nullif(F.sum(n), F.lit(0)), F.avg(v))
    return df.groupBy(group).agg(F.sum(n).alias("dropped"), mean.alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"))


def imbalance(df: DataFrame, part: str, value: str) -> DataFrame:
    """One row: min, max, their difference and mean of the parts' sums."""
    s = df.groupBy(part).agg(F.sum(value).alias("_s"))
    return s.agg(F.min("_s").alias("min"), F.max("_s").alias("max"), (F.max("_s") - F.min("_s")).alias("minmax_diff"), F.avg("_s").alias("mean"))


def collect_result(df: DataFrame, outcomes: dict[str, Column], reward: str, success: Column) -> DataFrame:
    """One row: how many rows had each outcome, and mean reward and success rate of those of the first."""
    first = next(iter(outcomes.values()))
    counts = [F.count_if(c).alias(n) for n, c in outcomes.items()]
    return df.agg(*counts, F.avg(F.when(first, F.col(reward))).alias("mean_reward"), share(F.when(first, success)).alias("success_rate"))


def inference_totals(df: DataFrame, request: str, order: str, prompt: str, generated: str, seconds: float) -> DataFrame:
    """One row over the last row of each request: requests, prompt and generated tokens, and both a second."""
    last = df.groupBy(request).agg(F.max_by(prompt, order).alias("_p"), F.max_by(generated, order).alias("_g"))
    n, g = F.count("*"), F.sum("_g")
    return last.agg(n.alias("requests"), F.sum("_p").alias("prompt_tokens"), g.alias("generated_tokens"), (n / seconds).alias("samples_s"), (g / seconds).alias("tokens_s"))


def distributed_mean(df: DataFrame, group: str, rank: str, value: str, counted: Column, empty: float = -1.0) -> DataFrame:
    """Mean by group from sums and counts of each rank; `empty` where no row counts."""
    parts = df.groupBy(group, rank).agg(F.sum(F.when(counted, F.col(value))).alias("_s"), F.count_if(counted).alias("_c"))
    return parts.groupBy(group).agg(F.coalesce(F.sum("_s") / F.nullif(F.sum("_c"), F.lit(0)), F.lit(empty)).alias("mean"))


def tail_ratio(df: DataFrame, value: str, share_: float = 0.9) -> DataFrame:
    """One row: share of rows above a percentile of the column, and its extremes."""
    (cut,) = quantiles(df, value, [share_])
    above = share(F.col(value) > F.lit(cut).cast("double"))
    return df.agg(above.alias("tail_ratio"), F.min(value).alias("min"), F.max(value).alias("max"))
