"""Connected components of an undirected graph, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialise, recorded


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp) of every vertex with an edge to another: comp is the smallest vertex it reaches. Edges with a null end, and from a vertex to itself, count as none.

    Each round takes the least label among a vertex and its neighbours, then follows the labels' own labels once, so long
    paths shorten by half. Labels are written each round, which cuts the lineage and deals both sides of the join anew.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("w")).filter("v <> w")
    both = materialise(both.union(both.select("w", "v")).distinct(), "cc-edges")
    with recorded() as first:
        labels = materialise(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("comp")), "cc-labels")
    while True:
        with recorded() as written:
            near = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("comp").alias("near"))
            hooked = materialise(labels.join(near, "v").select("v", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")), "cc-hooked")
            jump = hooked.select(F.col("v").alias("comp"), F.col("comp").alias("far"))
            moved = hooked.join(jump, "comp", "left").select("v", F.least(F.col("comp"), F.coalesce("far", "comp")).alias("comp"), "old")
            moved = materialise(moved, "cc-labels")
        changed = moved.filter("comp <> old").limit(1).count()
        drop(spark, first + written[:1])
        first, labels = written[1:], moved.select("v", "comp")
        if not changed:
            return labels
