"""Metric reduction, evaluation roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles, value_counts


def _has(name: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(name, F.lit(w))
    return out


#: Names with a rule of their own.
SUMMED = ["training/off_policy/dropped_samples", "validation/off_policy/dropped_samples"]
LAST = ["training/global_step", "training/rollout_probs_diff_valid"]


def rule_by_name(name: Column) -> Column:
    """max where the name contains "max", min where "min", else mean."""
    return F.when(_has(name, "max"), "max").when(_has(name, "min"), "min").otherwise("mean")


def weighted_rule(name: Column) -> Column:
    """last, time_sum, max, min, sum or weighted_avg; extremes go before means."""
    low = F.lower(name)
    rate = low.endswith("/lr") | low.endswith("_lr") | (low == "lr")
    return (
        F.when(name.isin(*SUMMED), "sum")
        .when(name.isin(*LAST) | rate, "last")
        .when(_has(low, "timing_s/", "timing_per_token_ms/"), "time_sum")
        .when(_has(low, "max"), "max")
        .when(_has(low, "min"), "min")
        .when(_has(low, "sum", "total"), "sum")
        .otherwise("weighted_avg")
    )


def async_rule(name: Column) -> Column:
    """As weighted_rule, but means go before extremes, and what is left is a plain mean."""
    low = F.lower(name)
    return (
        F.when(_has(low, "timing_s/"), "time_sum")
        .when(_has(low, "mean", "avg", "average"), "avg")
        .when(_has(low, "max"), "max")
        .when(_has(low, "min"), "min")
        .when(_has(low, "sum", "total"), "sum")
        .otherwise("avg")
    )


def reduce_metrics(df: DataFrame, rule: Column, name: str = "name", value: str = "value", weight: str = "weight", order: str = "step") -> DataFrame:
    """name, rule, value: each metric reduced by its rule. The rule depends on the name alone, so one aggregation serves all."""
    v, w = F.col(value), F.col(weight)
    plain = F.avg(v)
    by = df.groupBy(name).agg(
        F.max(v).alias("_max"),
        F.min(v).alias("_min"),
        F.sum(v).alias("_sum"),
        plain.alias("_avg"),
        F.when(F.sum(w) == 0, plain).otherwise(F.sum(v * w) / F.nullif(F.sum(w).cast("double"), F.lit(0.0))).alias("_wavg"),
        F.max_by(v, F.col(order)).alias("_last"),
    )
    by = by.withColumn("rule", rule)
    r = F.col("rule")
    out = F.when(r == "max", F.col("_max")).when(r == "min", F.col("_min")).when(r.isin("sum", "time_sum"), F.col("_sum"))
    out = out.when(r == "last", F.col("_last")).when(r == "weighted_avg", F.col("_wavg")).otherwise(F.col("_avg"))
    return by.select(name, "rule", out.alias("value"))


#: Fixed value: metrics that weigh by another one of their step, whose name is what stands before the ending.
STALENESS, ENDING = "/off_policy/dropped_samples_staleness/mean", "_staleness/mean"


def staleness_weighted(df: DataFrame, name: str = "name", value: str = "value", weight: str = "weight", step: str = "step") -> DataFrame:
    """Metrics in long form with the weight of each staleness mean replaced by the samples that its step dropped, where the step has that metric."""
    of = F.when(F.endswith(F.col(name), F.lit(STALENESS)), F.substring_index(F.col(name), ENDING, 1))
    dropped = df.filter(F.endswith(F.col(name), F.lit(STALENESS.removesuffix(ENDING)))).groupBy(F.col(step).alias("_step"), F.col(name).alias("_of")).agg(F.last(F.floor(value)).alias("_dropped"))
    both = df.withColumn("_name", of).join(dropped, (F.col(step) == F.col("_step")) & (F.col("_name") == F.col("_of")), "left")
    return both.withColumn(weight, F.coalesce("_dropped", weight)).select(*df.columns)


def derived(df: DataFrame, made: str, numerator: str, denominator: str, difference: bool = False, factor: float = 1.0) -> DataFrame:
    """Replaces or adds the metric `made` from two others of a reduced table, where both are there."""
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    pair = df.filter(F.col("name").isin(numerator, denominator)).agg(pick(numerator).alias("a"), pick(denominator).alias("b"))
    value = F.col("a") - F.col("b") if difference else F.col("a") / (F.col("b") * factor)
    new = pair.filter("a is not null and b is not null").select(F.lit(made).alias("name"), F.lit("derived").alias("rule"), value.alias("value"))
    return df.filter(F.col("name") != made).unionByName(new)


def typed_metrics(df: DataFrame, name: str, kind: str, rank: str, value: str) -> DataFrame:
    """Metrics of a declared kind (MEAN, SUM, MIN, MAX): first by rank, then over ranks; sums and means are averaged over ranks."""
    v = F.col(value)
    first = df.groupBy(name, kind, rank).agg(F.avg(v).alias("m"), F.sum(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    k = F.col(kind)
    by = F.when(k == "MEAN", F.avg("m")).when(k == "SUM", F.avg("s")).when(k == "MIN", F.min("lo")).otherwise(F.max("hi"))
    return first.groupBy(name, kind).agg(by.alias("value"))


def batch_stats(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """One row: mean, extremes and percentiles (linear interpolation) of a time; span and share of rows whose versions differ."""
    span = F.abs(F.col(end) - F.col(start))
    names = ("p50", "p95", "p99")
    percentiles = [F.lit(q).cast("double").alias(n) for n, q in zip(names, quantiles(df, time, [0.5, 0.95, 0.99]))]
    out = df.agg(
        F.avg(time).alias("avg"),
        F.max(time).alias("max"),
        F.min(time).alias("min"),
        F.max(span).alias("max_span"),
        F.avg(F.when(span == 0, 0.0).otherwise(1.0)).alias("partial_ratio"),
        F.count_distinct(end).alias("diversity"),
    )
    return out.select("avg", "max", "min", *percentiles, "max_span", "partial_ratio", "diversity")


def truthy(text: Column) -> Column:
    """true, false or null of a text."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "t", "1", "yes", "y"), True).when(low.isin("false", "f", "0", "no", "n"), False)


def success_rate(df: DataFrame, group: str, success: str, ignored: str) -> DataFrame:
    """counted, ignored, missing, successes and rate by group and overall (null group); rows of unparsable success stay in the denominator."""
    ok = truthy(F.col(success))
    out = df.rollup(group).agg(
        F.count_if(~F.col(ignored)).alias("counted"),
        F.count_if(F.col(ignored)).alias("ignored"),
        F.count_if(~F.col(ignored) & ok.isNull()).alias("missing"),
        F.count_if(~F.col(ignored) & F.coalesce(ok, F.lit(False))).alias("successes"),
    )
    return out.withColumn("rate", F.col("successes") / F.nullif("counted", F.lit(0)))


def pass_groups(df: DataFrame, group: str, passed: str) -> DataFrame:
    """One row a kind of group: all_pass, all_fail or mixed, with passes and the number of groups."""
    by = df.groupBy(group).agg(F.count_if(passed).alias("passes"), F.count("*").alias("n"))
    kind = F.when(F.col("passes") == F.col("n"), "all_pass").when(F.col("passes") == 0, "all_fail").otherwise("mixed")
    return by.groupBy(kind.alias("kind"), "passes").agg(F.count("*").alias("groups"))


def leaderboard(df: DataFrame, rows: list[str], column: str, values: list, value: str, order: str) -> DataFrame:
    """One column a value of `column`; of several rows in one cell the last in the order stays."""
    return df.groupBy(*rows).pivot(column, values).agg(F.max_by(value, order))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, share of equal verdicts, Cohen's kappa of two binary columns and their Pearson correlation."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("rate"), F.avg(x).alias("p"), F.avg(y).alias("q"), F.corr(x, y).alias("pearson"))
    chance = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    return s.select("n", "rate", F.when(chance < 1, (F.col("rate") - chance) / (1 - chance)).otherwise(1.0).alias("kappa"), "pearson")


def upper_median(df: DataFrame, value: str, key: str) -> DataFrame:
    """rows, max and sorted[n // 2] of a column, from counts by value: no task sorts the whole table."""
    total = df.agg(F.count("*").alias("rows"), F.max(value).alias("max"))
    half = F.floor(F.col("rows") / 2)
    ranked = value_counts(df, value).crossJoin(F.broadcast(total))
    found = ranked.filter((F.col("before") <= half) & (F.col("before") + F.col("n") > half)).select(F.col(value).alias("upper_median"))
    return total.join(found, F.lit(True), "left").select("rows", "max", "upper_median")


#: Rows whose digests, of five characters each, one task may hold.
MAX_CHECKSUM_ROWS = 10_000_000


def table_checksum(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """md5 over the first five characters of each row's md5, rows in order.

    By its definition one string of five characters a row is digested, so a table of over MAX_CHECKSUM_ROWS rows is refused; for those
    take range_checksum.
    """
    row = F.substring(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in columns])), 1, 5)
    count = df.agg(F.count("*").alias("_n"))
    few = F.when(F.col("_n") <= MAX_CHECKSUM_ROWS, True).otherwise(F.raise_error(F.lit("too many rows for this checksum")).cast("boolean"))
    packed = F.array_sort(F.collect_list(F.struct(*order, row.alias("h"))))
    return df.crossJoin(F.broadcast(count)).filter(few).agg(F.md5(F.array_join(F.transform(packed, lambda x: x["h"]), "")).alias("checksum"))


def range_checksum(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A checksum of any number of rows, which no order of theirs changes: rows, and the sums of the halves of each row's 128-bit md5 as md5.

    Equal tables have equal checksums; it is not table_checksum's digest.
    """
    cells = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in [*order, *columns]]
    digest = F.md5(F.concat_ws("|", *cells))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count("*").alias("rows"), half(1).alias("a"), half(17).alias("b"))
    return sums.select("rows", F.md5(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))).alias("checksum"))


def memory_contribution(df: DataFrame, memory: str, kind: str, chosen: str, reward: str) -> DataFrame:
    """By memory: mean over task types of (mean reward when chosen - mean of its pool) * share chosen; pools of one row or one side don't count."""
    n, k = F.count("*"), F.count_if(chosen)
    by = df.groupBy(memory, kind).agg(n.alias("n"), k.alias("k"), F.avg(reward).alias("base"), F.avg(F.when(F.col(chosen), F.col(reward))).alias("with"))
    counts = (F.col("n") >= 2) & (F.col("k") > 0) & (F.col("k") < F.col("n"))
    part = F.when(counts, (F.col("with") - F.col("base")) * F.col("k") / F.col("n"))
    return by.groupBy(memory).agg(F.coalesce(F.avg(part), F.lit(0.0)).alias("contribution"), F.sum("k").alias("selected"))


#: Weights of memory tiers; any other tier weighs 1.
TIER_WEIGHTS = {"skill": 1.0, "tip": 0.8, "tool": 1.2, "trajectory": 0.9}


def memory_score(df: DataFrame, tier: str) -> DataFrame:
    """Adds `score` = tier weight * confidence * contribution; recency is 1 whatever the last use."""
    weight = F.coalesce(*[F.when(F.col(tier) == t, F.lit(w)) for t, w in TIER_WEIGHTS.items()], F.lit(1.0))
    confidence = 1 - 1 / F.sqrt(1 + F.col("selected"))
    return df.withColumn("score", weight * confidence * F.col("contribution"))


def selector_metrics(df: DataFrame, gold: str, predicted: str, k: int) -> DataFrame:
    """One row: count, exact set match, mean precision, recall, F1, and the same of the first k predictions."""

    def div(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    def three(pred: Column) -> list[Column]:
        both = F.size(F.array_intersect(pred, gold))
        p, r = div(both, F.size(F.array_distinct(pred))), div(both, F.size(F.array_distinct(gold)))
        return [p, r, div(2 * p * r, p + r)]

    exact = (F.size(F.array_except(gold, predicted)) == 0) & (F.size(F.array_except(predicted, gold)) == 0)
    top = F.slice(predicted, 1, k)
    names = ["precision", "recall", "f1", "p_at_k", "r_at_k", "f1_at_k"]
    return df.agg(
        F.count("*").alias("count"),
        F.avg(exact.cast("double")).alias("exact_set_match"),
        *[F.avg(c).alias(n) for n, c in zip(names, [*three(F.col(predicted)), *three(top)])],
    )


def skill_rates(df: DataFrame, skills: str, correct: str, known: DataFrame) -> DataFrame:
    """Rate of right rows for every known skill; a skill without rows has -1."""
    each = df.select(F.explode(F.array_distinct(skills)).alias("skill"), correct)
    by = each.groupBy("skill").agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("r"))
    return known.join(by, "skill", "left").select("skill", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("r", F.lit(-1.0)).alias("rate"))


def pass_at_k(df: DataFrame, task: str, passed: str, k: int) -> DataFrame:
    """Unbiased pass@k by task: 1 - C(n - c, k) / C(n, k), as a product of k factors."""
    by = df.groupBy(task).agg(F.count("*").alias("n"), F.count_if(passed).alias("c"))
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * (F.col("n") - F.col("c") - i) / F.greatest(F.col("n") - i, F.lit(1))
    value = F.when(F.col("n") - F.col("c") < k, 1.0).otherwise(1 - miss)
    return by.select(task, "n", "c", value.alias("pass_at_k"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, rows only in b, counting repeats."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_a"))
    return left.crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))
