"""Choice of refinement rounds and of the best row of a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def choose_round(df: DataFrame, task: str, round_: str, score: str, complete: str, errors: str | None = None) -> DataFrame:
    """By task: the first complete round (`complete_first_try` if it is the first round, else `complete_after_refine`); else the round that improves
    most on the one before (earliest of those within 1e-12) and beats round one by more than 1e-9: `improved_partial`, with source, target and delta.

    Rounds with checker errors are never targets. Tasks without either are left out.
    """
    w = Window.partitionBy(task).orderBy(round_)
    ok = (F.coalesce(F.col(errors), F.lit(0)) == 0) if errors else F.lit(True)
    rows = df.withColumn("_ok", ok)
    rows = rows.withColumn("_gain", F.round(F.col(score) - F.lag(score).over(w), 12)).withColumn("_source", F.lag(round_).over(w))
    rows = rows.withColumn("_base", F.first(score).over(w)).withColumn("_no", F.row_number().over(w))
    done = F.when(F.col(complete) & F.col("_ok"), F.col(round_))
    better = F.col("_ok") & (F.col("_gain") > 0) & (F.col(score) > F.col("_base") + 1e-9)
    best = F.max(F.when(better, F.struct(F.col("_gain").alias("gain"), (-F.col(round_)).alias("neg"), F.col("_source").alias("source"), F.col(round_).alias("target"))))
    by = rows.groupBy(task).agg(F.min(done).alias("first_done"), F.min(round_).alias("first_round"), best.alias("best"))
    kind = F.when(F.col("first_done") == F.col("first_round"), "complete_first_try").when(F.col("first_done").isNotNull(), "complete_after_refine").when(F.col("best").isNotNull(), "improved_partial")
    by = by.withColumn("kind", kind).filter("kind is not null")
    partial = F.col("kind") == "improved_partial"
    return by.select(
        task,
        "kind",
        F.when(partial, F.col("best.source")).alias("source"),
        F.when(partial, F.col("best.target")).otherwise(F.col("first_done")).alias("target"),
        F.when(partial, F.col("best.gain")).alias("delta"),
    )


def best_per_task(df: DataFrame, task: str, priority: str, score: str, ordinal: str) -> DataFrame:
    """By task the row of highest priority (smallest number), then score; of equal ones the first."""
    order = [F.col(priority), F.col(score).desc_nulls_last(), F.col(ordinal)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(task).orderBy(*order))).filter("_n = 1").drop("_n")
