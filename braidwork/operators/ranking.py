"""Ranking, ordinal pairing and other order-dependent operators. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reranker_metrics(df: DataFrame, stream: str, order: list[str], label: str, score: str, key: str) -> DataFrame:
    """MRR and NDCG by query; a query begins at each positive of its stream, and one of a single row is skipped."""
    rows = df.withColumn("query_no", F.sum(label).over(Window.partitionBy(stream).orderBy(*order))).filter("query_no > 0")
    w = Window.partitionBy(stream, "query_no")
    rows = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.col(score).desc(), key)))
    # one positive stands at the head of each query, so the ideal gain is 1
    out = rows.groupBy(stream, "query_no").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col(label) == 1, 1 / F.col("_rank")).otherwise(0.0)).alias("mrr"),
        F.sum(F.col(label) / F.log2(F.col("_rank") + 1)).alias("ndcg"),
    )
    return out.filter("n >= 2")


def best_of_n(df: DataFrame, group: str, prm: str, orm: str, key: list[str], n: int, easy: float) -> DataFrame:
    """The n best rows that are right (never the worst row) as positives and the worst row as negative, by prm + 10 * orm; easy groups are skipped."""
    w = Window.partitionBy(group)
    score = F.col(prm) + 10 * F.col(orm)
    rows = df.withColumn("_score", score)
    rows = rows.withColumn("_best", F.row_number().over(w.orderBy(F.col("_score").desc(), *key)))
    rows = rows.withColumn("_worst", F.row_number().over(w.orderBy("_score", *[F.col(k).desc() for k in key])))
    rows = rows.withColumn("_easy", F.avg(orm).over(w)).withColumn("_n", F.count("*").over(w)).filter((F.col("_n") > 1) & (F.col("_easy") < easy))
    kind = F.when(F.col("_worst") == 1, "negative").when((F.col(orm) == 1) & (F.col("_best") <= n), "positive")
    return rows.withColumn("kind", kind).filter("kind is not null").drop("_score", "_best", "_worst", "_easy", "_n")


def neighbours(centers: DataFrame, turns: DataFrame, group: str, center: str, turn: str, before: int, after: int) -> DataFrame:
    """Turns from `before` ahead of each center to `after` behind it: each center meets its few offsets by equi-join."""
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    wanted = centers.select(group, center, offsets.alias("_d")).select(group, center, (F.col(center) + F.col("_d")).alias(turn))
    return wanted.join(turns, [group, turn])


def step_references(df: DataFrame, key: str, text: str) -> DataFrame:
    """Steps named in a text, singly or as a-b."""
    rows = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(\d+(?:-\d+)?)"), 1)).alias("_r"))
    a = F.split_part("_r", F.lit("-"), F.lit(1)).cast("long")
    b = F.when(F.contains("_r", F.lit("-")), F.split_part("_r", F.lit("-"), F.lit(2)).cast("long")).otherwise(a)
    return rows.filter(b >= a).select(key, F.explode(F.sequence(a, b)).alias("step")).distinct()


def switches(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """How often the value differs from the row before, by group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    rows = df.select(group, (before.isNotNull() & (before != F.col(value))).alias("_s"))
    return rows.groupBy(group).agg(F.count_if("_s").alias("switches"))


def rank_report(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n lowest and the n highest rows."""
    low = df.orderBy(value, key).limit(n).select(F.lit("hardest").alias("kind"), key, value)
    return low.unionByName(df.orderBy(F.col(value).desc(), key).limit(n).select(F.lit("easiest").alias("kind"), key, value))


def ordinal_join(left: DataFrame, right: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """The k-th row of left with the k-th of right, by group."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("k")
    a = left.select(group, k, F.col(key).alias("call_id"))
    b = right.select(group, k, F.col(key).alias("result_id"))
    return a.join(b, [group, "k"])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_seen(df: DataFrame, keys: list[str], line: str, value: str, first: str = "first_line", last: str = "last_value") -> DataFrame:
    """One row a key of a log: the line where it was seen first, which orders the keys, and its value in its last line."""
    return df.groupBy(*keys).agg(F.min(line).alias(first), F.max_by(value, line).alias(last))
