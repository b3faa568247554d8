"""Queries of group statistics, advantages and other windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.operators import filters, groups, ranking

from .registry import query, table

_KEY = "l_orderkey, l_partkey, l_suppkey"
_ID = ["l_orderkey", "l_partkey", "l_suppkey"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*_ID, "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("A01_group_stats", """
SELECT l_orderkey, round(CASE WHEN count(*) <= 1 THEN 0 ELSE avg(l_quantity) END, 4) AS mean,
  round(CASE WHEN count(*) <= 1 THEN 1 ELSE sqrt(greatest(var_samp(l_quantity), 1e-6)) END, 4) AS std, count(*) AS count
FROM lineitem GROUP BY l_orderkey""")
def a01(spark, sf):
    out = groups.group_stats(_lines(spark, sf), "l_orderkey", "l_quantity")
    return out.select("l_orderkey", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "count")


@query("A02_group_codes", """
WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS label FROM events)
SELECT event_id, dense_rank() OVER (ORDER BY label) - 1 AS mixed, user_id AS digits, user_id AS near FROM x""")
def a02(spark, sf):
    user = F.col("user_id").cast("string")
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(user).alias("a"), user.alias("b"), (F.col("user_id") + 1e-8).alias("c"))
    for label, name in (("a", "mixed"), ("b", "digits"), ("c", "near")):
        rows = groups.group_codes(rows, label, name)
    return rows.select("event_id", "mixed", "digits", "near")


@query("A03_weighted_reward", f"""
SELECT {_KEY}, round(coalesce(nullif(CASE WHEN l_tax > 0 THEN l_quantity / 10 END, NULL), 0) * 0.7 + CASE WHEN l_discount > 0.02 THEN l_discount ELSE 0 END * 0.3, 6) AS reward FROM lineitem""")
def a03(spark, sf):
    rows = _lines(spark, sf).withColumn("a", F.when(F.col("l_tax") > 0, F.col("l_quantity") / 10))
    rows = rows.withColumn("b", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).otherwise(F.lit(float("nan"))))
    return groups.weighted_reward(rows, ["a", "b"], [0.7, 0.3]).select(*_ID, F.round("reward", 6).alias("reward"))


@query("A04_reward_metrics", """
WITH g AS (SELECT l_orderkey, sum(l_quantity) AS s, count(*) AS n, coalesce(stddev_samp(l_quantity), 0) AS sd FROM lineitem GROUP BY 1),
p AS (SELECT avg(l_discount) AS dm, stddev_samp(l_discount) AS ds, avg(l_tax) AS tm, stddev_samp(l_tax) AS ts FROM lineitem)
SELECT round(sum(s) / sum(n), 4) AS reward_mean, round(avg(sd), 4) AS reward_std, round(avg(CASE WHEN sd < 1e-6 THEN 1 ELSE 0 END), 4) AS frac_zero_std,
  round(any_value(dm), 4) AS l_discount_mean, round(any_value(ds), 4) AS l_discount_std, round(any_value(tm), 4) AS l_tax_mean, round(any_value(ts), 4) AS l_tax_std FROM g, p""")
def a04(spark, sf):
    out = groups.reward_metrics(_lines(spark, sf), "l_orderkey", "l_quantity", ["l_discount", "l_tax"])
    return out.select([F.round(c, 4).alias(c) for c in out.columns])


@query("F14_zero_variance_groups", """
SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING coalesce(stddev_samp(l_quantity), 0) = 0""")
def f14(spark, sf):
    return filters.constant_groups(_lines(spark, sf), "l_orderkey", "l_quantity")


def _advantage(name, estimator, scale, sql):
    @query(name, f"SELECT {_KEY}, round({sql}, 4) AS advantage FROM (SELECT *, l_quantity - avg(l_quantity) OVER g AS d, count(*) OVER g AS n, coalesce(stddev_samp(l_quantity) OVER g, 0) AS sd FROM lineitem WINDOW g AS (PARTITION BY l_orderkey))")
    def run(spark, sf):
        return groups.advantages(_lines(spark, sf), "l_orderkey", "l_quantity", estimator, scale).select(*_ID, F.round("advantage", 4).alias("advantage"))

    return run


w01 = _advantage("W01_group_advantage", "grpo", "group", "d / (sd + 1e-4)")
_advantage("W01_batch_advantage", "grpo", "batch", "d / ((SELECT stddev_samp(l_quantity) FROM lineitem) + 1e-4)")
_advantage("W01_unscaled_advantage", "grpo", "none", "d")
_advantage("W02_rloo", "rloo", "group", "CASE WHEN n > 1 THEN d * n / (n - 1) ELSE d END / (sd + 1e-4)")
_advantage("W03_reinforce_batch", "reinforce_plus_plus", "batch", "d / (stddev_samp(d) OVER () + 1e-4)")
_advantage("W03_reinforce_group", "reinforce_plus_plus", "group", "d / (coalesce(stddev_samp(d) OVER (PARTITION BY l_orderkey), 0) + 1e-4)")


@query("W04_gdpo", f"""
WITH z AS (SELECT {_KEY}, coalesce((l_quantity - avg(l_quantity) OVER g) / (coalesce(stddev_samp(l_quantity) OVER g, 0) + 1e-8), 0) * 1.0
  + coalesce((l_linenumber - avg(l_linenumber) OVER g) / (coalesce(stddev_samp(l_linenumber) OVER g, 0) + 1e-8), 0) * 0.5 AS s FROM lineitem WINDOW g AS (PARTITION BY l_orderkey))
SELECT {_KEY}, round((s - avg(s) OVER ()) / (stddev_samp(s) OVER () + 1e-8), 4) + 0.0 AS advantage FROM z""")
def w04(spark, sf):
    rows = _lines(spark, sf).withColumn("line", F.col("l_linenumber").cast("double"))
    return groups.gdpo(rows, "l_orderkey", ["l_quantity", "line"], [1.0, 0.5]).select(*_ID, (F.round("advantage", 4) + 0.0).alias("advantage"))


@query("W05_dynamic_groups", """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1),
a AS (SELECT o_custkey, o_orderpriority, (o_totalprice - avg(o_totalprice) OVER g) / (coalesce(stddev_samp(o_totalprice) OVER g, 0) + 1e-4) AS advantage FROM l WINDOW g AS (PARTITION BY o_custkey))
SELECT o_orderkey, round(advantage, 4) AS advantage FROM orders JOIN a USING (o_custkey, o_orderpriority)""")
def w05(spark, sf):
    rows = table(spark, sf, "orders").withColumn("request", F.concat_ws("|", "o_custkey", "o_orderpriority"))
    out = groups.dynamic_group_advantages(rows, "request", "o_custkey", "o_totalprice", ["o_orderkey"])
    return out.select("o_orderkey", F.round("advantage", 4).alias("advantage"))


@query("W06_session_advantage", """
WITH f AS (SELECT o_custkey, o_orderpriority, max_by(o_totalprice, o_orderkey) AS r FROM orders GROUP BY ALL),
a AS (SELECT o_custkey, o_orderpriority, (r - avg(r) OVER g) / (coalesce(stddev_samp(r) OVER g, 0) + 1e-4) AS advantage FROM f WINDOW g AS (PARTITION BY o_custkey))
SELECT o_orderkey, round(advantage, 4) AS advantage FROM orders JOIN a USING (o_custkey, o_orderpriority)""")
def w06(spark, sf):
    out = groups.session_advantages(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return out.select("o_orderkey", F.round("advantage", 4).alias("advantage"))


@query("W07_token_advantage", f"""
WITH t AS (SELECT {_KEY}, l_quantity / 10 AS adv, unnest([l_tax - l_discount, l_discount - l_tax, 0.5 - l_tax]) AS d, unnest([1, 2, 3]) AS i FROM lineitem)
SELECT {_KEY}, i, round(adv + 0.1 * d, 4) AS token_advantage, round(exp(d) - d - 1, 4) AS k3 FROM t""")
def w07(spark, sf):
    rows = _lines(spark, sf).withColumn("adv", F.col("l_quantity") / 10)
    rows = rows.withColumn("student", F.array("l_discount", "l_tax", "l_tax")).withColumn("teacher", F.array("l_tax", "l_discount", F.lit(0.5)))
    out = groups.token_advantages(rows, "adv", "student", "teacher", 0.1)
    out = out.select(*_ID, F.posexplode(F.arrays_zip("token_advantage", "k3")).alias("i", "x"))
    return out.select(*_ID, (F.col("i") + 1).alias("i"), F.round("x.token_advantage", 4).alias("token_advantage"), F.round("x.k3", 4).alias("k3"))


@query("W08_discounted_reward", """
SELECT event_id, round(pow(0.9, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) * max(value) OVER (PARTITION BY user_id), 4) AS step_reward FROM events""")
def w08(spark, sf):
    total = F.max("value").over(Window.partitionBy("user_id"))
    out = groups.discounted(table(spark, sf, "events"), "user_id", ["ts", "event_id"], total, 0.9)
    return out.select("event_id", F.round("step_reward", 4).alias("step_reward"))


@query("W11_mrr_ndcg", """
WITH e AS (SELECT user_id, event_id, ts, value, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS rel FROM events),
g AS (SELECT *, sum(rel) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, q ORDER BY value DESC, event_id) AS rk, count(*) OVER (PARTITION BY user_id, q) AS n FROM g WHERE q > 0)
SELECT user_id, q AS query_no, n, round(max(CASE WHEN rel = 1 THEN 1.0 / rk ELSE 0 END), 6) AS mrr, round(sum(rel / log2(rk + 1)), 6) AS ndcg FROM r WHERE n >= 2 GROUP BY ALL""")
def w11(spark, sf):
    rows = table(spark, sf, "events").withColumn("rel", F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    out = ranking.reranker_metrics(rows, "user_id", ["ts", "event_id"], "rel", "value", "event_id")
    return out.select("user_id", "query_no", "n", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@query("W12_best_of_n", """
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity + 10 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS orm FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey, l_suppkey) AS best, row_number() OVER (PARTITION BY l_orderkey ORDER BY score, l_partkey DESC, l_suppkey DESC) AS worst,
  avg(orm) OVER (PARTITION BY l_orderkey) AS easy, count(*) OVER (PARTITION BY l_orderkey) AS n FROM s)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN worst = 1 THEN 'negative' ELSE 'positive' END AS kind FROM r WHERE n > 1 AND easy < 0.8 AND (worst = 1 OR (orm = 1 AND best <= 2))""")
def w12(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("orm", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return ranking.best_of_n(rows, "l_orderkey", "l_quantity", "orm", ["l_partkey", "l_suppkey"], n=2, easy=0.8).select(*_ID, "kind")


@query("W13_min_max", f"""
SELECT {_KEY}, round(CASE WHEN min(l_quantity) OVER g = max(l_quantity) OVER g THEN least(1, l_quantity) ELSE (l_quantity - min(l_quantity) OVER g) / (max(l_quantity) OVER g - min(l_quantity) OVER g + 1e-5) END, 4) AS normalised
FROM lineitem WINDOW g AS (PARTITION BY l_orderkey)""")
def w13(spark, sf):
    return groups.min_max(_lines(spark, sf), "l_orderkey", "l_quantity").select(*_ID, F.round("normalised", 4).alias("normalised"))


@query("W14_adjacent_turns", """
SELECT a.conv_id, a.turn AS center, b.turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 2 WHERE a.role = 'user'""")
def w14(spark, sf):
    turns = table(spark, sf, "conversations")
    centers = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("center"))
    return ranking.neighbours(centers, turns, "conv_id", "center", "turn", 1, 2).select("conv_id", "center", "turn", "role")


@query("W15_step_references", r"""
WITH s AS (SELECT event_id, 'see steps ' || CAST(user_id % 7 AS VARCHAR) || '-' || CAST(user_id % 7 + event_id % 4 AS VARCHAR) || ', ' || CAST(event_id % 50 AS VARCHAR) AS t FROM events),
m AS (SELECT event_id, unnest(regexp_extract_all(t, '\d+(?:-\d+)?')) AS r FROM s)
SELECT DISTINCT event_id, unnest(range(CAST(split_part(r, '-', 1) AS BIGINT), CAST(CASE WHEN contains(r, '-') THEN split_part(r, '-', 2) ELSE r END AS BIGINT) + 1)) AS step FROM m""")
def w15(spark, sf):
    text = F.format_string("see steps %d-%d, %d", F.col("user_id") % 7, F.col("user_id") % 7 + F.col("event_id") % 4, F.col("event_id") % 50)
    return ranking.step_references(table(spark, sf, "events").select("event_id", text.alias("text")), "event_id", "text")


@query("W16_prefix_switches", """
SELECT user_id, count(*) FILTER (p IS NOT NULL AND p <> event_type) AS switches FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id""")
def w16(spark, sf):
    return ranking.switches(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("W17_rank_report", """
WITH a AS (SELECT user_id, round(avg(value), 6) AS accuracy FROM events GROUP BY 1)
(SELECT 'hardest' AS kind, user_id, accuracy FROM a ORDER BY accuracy, user_id LIMIT 3) UNION ALL (SELECT 'easiest', user_id, accuracy FROM a ORDER BY accuracy DESC, user_id LIMIT 3)""")
def w17(spark, sf):
    by = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("accuracy"))
    return ranking.rank_report(by, "accuracy", "user_id", 3)


@query("W18_first_seen", """
SELECT user_id, event_type, min(event_id) AS first_line, max_by(value, event_id) AS last_value FROM events GROUP BY ALL""")
def w18(spark, sf):
    return ranking.first_seen(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", "value", "first_line", "last_value")


@query("J11_ordinal_pairs", """
WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view')
SELECT user_id, k, c.event_id AS call_id, r.event_id AS result_id FROM c JOIN r USING (user_id, k)""")
def j11(spark, sf):
    events = table(spark, sf, "events")
    return ranking.ordinal_join(events.filter("event_type = 'click'"), events.filter("event_type = 'view'"), "user_id", ["ts", "event_id"], "event_id")


@query("J12_previous_round", """
SELECT event_id, lag(event_id) OVER w AS previous_id, round(value - lag(value) OVER w, 4) AS gain FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def j12(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gain = F.round(F.col("value") - F.lag("value").over(w), 4)
    return table(spark, sf, "events").select("event_id", F.lag("event_id").over(w).alias("previous_id"), gain.alias("gain"))
