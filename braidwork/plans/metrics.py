"""Queries of metric reduction, evaluation roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import metrics, reports

from .registry import query, table

# Metrics in long form: a step a day, names by type of event.
_LONG = """(SELECT CAST(datediff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) * 100000 + event_id AS step, value, user_id % 5 AS weight,
  CASE event_type WHEN 'view' THEN 'actor/pg_loss/mean' WHEN 'click' THEN 'grad/max' WHEN 'purchase' THEN 'timing_s/step' WHEN 'signup' THEN 'global_seqlen/max' ELSE 'global_seqlen/min' END AS name FROM events)"""


def _long(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "view", "actor/pg_loss/mean").when(kind == "click", "grad/max").when(kind == "purchase", "timing_s/step")
    name = name.when(kind == "signup", "global_seqlen/max").otherwise("global_seqlen/min")
    step = F.datediff("ts", F.lit("2024-01-01")).cast("long") * 100000 + F.col("event_id")
    return table(spark, sf, "events").select(step.alias("step"), "value", (F.col("user_id") % 5).alias("weight"), name.alias("name"))


def _rounded(df, n=4):
    return df.select([F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("A05_mean_by_source", """
SELECT source, round(avg(s), 4) AS score FROM (SELECT source, (quality + toxic) / 2 AS s FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def a05(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").withColumn("scores", F.array("quality", "toxic"))
    return _rounded(reports.mean_by_source(rows, "source", "scores"))


@query("A06_reduce_by_name", f"""
SELECT name, CASE WHEN contains(name, 'max') THEN 'max' WHEN contains(name, 'min') THEN 'min' ELSE 'mean' END AS rule,
  round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 4) AS value FROM {_LONG} GROUP BY name""")
def a06(spark, sf):
    return _rounded(metrics.reduce_metrics(_long(spark, sf), metrics.rule_by_name(F.col("name"))))


@query("A07_typed_metrics", """
WITH r AS (SELECT event_type, CASE event_type WHEN 'view' THEN 'MEAN' WHEN 'click' THEN 'SUM' WHEN 'error' THEN 'MIN' ELSE 'MAX' END AS kind, user_id % 8 AS rank, avg(value) AS m, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)
SELECT event_type, kind, round(CASE kind WHEN 'MEAN' THEN avg(m) WHEN 'SUM' THEN avg(s) WHEN 'MIN' THEN min(lo) ELSE max(hi) END, 3) AS value FROM r GROUP BY event_type, kind""")
def a07(spark, sf):
    e = F.col("event_type")
    kind = F.when(e == "view", "MEAN").when(e == "click", "SUM").when(e == "error", "MIN").otherwise("MAX")
    rows = table(spark, sf, "events").withColumn("kind", kind).withColumn("rank", F.col("user_id") % 8)
    return _rounded(metrics.typed_metrics(rows, "event_type", "kind", "rank", "value"), 3)


@query("A08_weighted_metrics", f"""
WITH r AS (SELECT name, CASE WHEN contains(name, 'timing_s/') THEN 'time_sum' WHEN contains(name, 'max') THEN 'max' WHEN contains(name, 'min') THEN 'min' ELSE 'weighted_avg' END AS rule,
  CASE WHEN contains(name, 'timing_s/') THEN sum(value) WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE sum(value * weight) / sum(weight) END AS value FROM {_LONG} GROUP BY name)
SELECT name, rule, round(value, 3) AS value FROM r UNION ALL
SELECT 'global_seqlen/minmax_diff', 'derived', round(max(value) FILTER (name = 'global_seqlen/max') - max(value) FILTER (name = 'global_seqlen/min'), 3) FROM r""")
def a08(spark, sf):
    out = metrics.reduce_metrics(_long(spark, sf), metrics.weighted_rule(F.col("name")))
    return _rounded(metrics.derived(out, "global_seqlen/minmax_diff", "global_seqlen/max", "global_seqlen/min", difference=True), 3)


_DROPS = """(SELECT CAST(event_id AS BIGINT) AS step, event_type, user_id % 4 AS dropped, value, 7 AS samples FROM events)"""


@query("A08_staleness_weights", f"""
SELECT 'training/off_policy/dropped_samples' AS name, 'sum' AS rule, CAST(sum(dropped) AS DOUBLE) AS value FROM {_DROPS} WHERE event_type <> 'error'
UNION ALL SELECT 'training/off_policy/dropped_samples_staleness/mean', 'weighted_avg', round(sum(value * CASE WHEN event_type = 'error' THEN samples ELSE dropped END) / sum(CASE WHEN event_type = 'error' THEN samples ELSE dropped END), 4) FROM {_DROPS}""")
def a08_staleness(spark, sf):
    """A step's staleness weighs as many samples as the step dropped; where the step doesn't say, as its samples."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("step"), "event_type", (F.col("user_id") % 4).cast("double").alias("dropped"), "value", F.lit(7).alias("weight"))
    drops = e.filter("event_type <> 'error'").select("step", F.lit("training/off_policy/dropped_samples").alias("name"), F.col("dropped").alias("value"), "weight")
    stale = e.select("step", F.lit("training/off_policy/dropped_samples_staleness/mean").alias("name"), "value", "weight")
    rows = metrics.staleness_weighted(drops.unionByName(stale))
    return _rounded(metrics.reduce_metrics(rows, metrics.weighted_rule(F.col("name"))))


@query("A09_async_metrics", f"""
WITH r AS (SELECT name, CASE WHEN contains(name, 'timing_s/') THEN 'time_sum' WHEN contains(name, 'mean') THEN 'avg' WHEN contains(name, 'max') THEN 'max' WHEN contains(name, 'min') THEN 'min' ELSE 'avg' END AS rule,
  CASE WHEN contains(name, 'timing_s/') THEN sum(value) WHEN contains(name, 'mean') THEN avg(value) WHEN contains(name, 'max') THEN max(value) ELSE min(value) END AS value
  FROM (SELECT step, value, CASE WHEN name = 'grad/max' THEN 'grad/max/mean' WHEN name = 'global_seqlen/max' THEN 'timing_s/gen' ELSE name END AS name FROM {_LONG}) GROUP BY name)
SELECT name, rule, round(value, 3) AS value FROM r UNION ALL
SELECT 'fully_async/trainer/idle_ratio', 'derived', round(max(value) FILTER (name = 'timing_s/gen') / max(value) FILTER (name = 'timing_s/step'), 3) FROM r""")
def a09(spark, sf):
    name = F.col("name")
    rows = _long(spark, sf).withColumn("name", F.when(name == "grad/max", "grad/max/mean").when(name == "global_seqlen/max", "timing_s/gen").otherwise(name))
    out = metrics.reduce_metrics(rows, metrics.async_rule(name))
    return _rounded(metrics.derived(out, "fully_async/trainer/idle_ratio", "timing_s/gen", "timing_s/step"), 3)


@query("A10_batch_stats", """
SELECT round(avg(l_quantity), 4) AS avg, max(l_quantity) AS max, min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.5), 4) AS p50, round(quantile_cont(l_quantity, 0.95), 4) AS p95, round(quantile_cont(l_quantity, 0.99), 4) AS p99,
  max(abs(l_linenumber - l_suppkey % 5)) AS max_span, round(avg(CASE WHEN l_linenumber = l_suppkey % 5 THEN 0 ELSE 1 END), 4) AS partial_ratio, count(DISTINCT l_linenumber) AS diversity FROM lineitem""")
def a10(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("start", F.col("l_suppkey") % 5)
    return _rounded(metrics.batch_stats(rows, "l_quantity", "start", "l_linenumber"))


@query("A11_success_rate", """
WITH x AS (SELECT event_type, user_id % 10 = 0 AS ignored, CASE user_id % 7 WHEN 0 THEN 'True' WHEN 1 THEN ' yes ' WHEN 2 THEN '0' WHEN 3 THEN 'n' WHEN 4 THEN '1' ELSE 'maybe' END AS s FROM events),
y AS (SELECT event_type, ignored, CASE WHEN lower(trim(s)) IN ('true', 't', '1', 'yes', 'y') THEN 1 WHEN lower(trim(s)) IN ('false', 'f', '0', 'no', 'n') THEN 0 END AS ok FROM x)
SELECT event_type, count(*) FILTER (NOT ignored) AS counted, count(*) FILTER (ignored) AS ignored, count(*) FILTER (NOT ignored AND ok IS NULL) AS missing, count(*) FILTER (NOT ignored AND ok = 1) AS successes,
  round(count(*) FILTER (NOT ignored AND ok = 1) / nullif(count(*) FILTER (NOT ignored), 0), 4) AS rate FROM y GROUP BY ROLLUP (event_type)""")
def a11(spark, sf):
    m = F.col("user_id") % 7
    s = F.when(m == 0, "True").when(m == 1, " yes ").when(m == 2, "0").when(m == 3, "n").when(m == 4, "1").otherwise("maybe")
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 10 == 0).alias("skip"), s.alias("s"))
    return _rounded(metrics.success_rate(rows, "event_type", "s", "skip"))


@query("A12_episode_report", """
SELECT event_type, count(*) AS episodes, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 4) AS pass_rate, round(avg(value), 4) AS avg_reward, count(*) FILTER (value < 1) AS early_exits,
  count(*) FILTER (user_id % 2 = 0) AS with_advice, round(avg(value) FILTER (user_id % 2 = 0), 4) AS avg_with, round(avg(value) FILTER (user_id % 2 = 1), 4) AS avg_without FROM events GROUP BY event_type""")
def a12(spark, sf):
    v, u = F.col("value"), F.col("user_id")
    return _rounded(reports.episode_report(table(spark, sf, "events"), "event_type", "value", v > 50, v < 1, u % 2 == 0))


@query("A13_pass_groups", """
SELECT CASE WHEN p = n THEN 'all_pass' WHEN p = 0 THEN 'all_fail' ELSE 'mixed' END AS kind, p AS passes, count(*) AS groups
FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS p, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY ALL""")
def a13(spark, sf):
    return metrics.pass_groups(table(spark, sf, "lineitem").withColumn("ok", F.col("l_returnflag") == "A"), "l_orderkey", "ok")


@query("A14_accuracy_sets", """
SELECT o_orderstatus, o_orderpriority, c_mktsegment, count(*) AS n, round(avg(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END), 4) AS accuracy
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (c_mktsegment), ())""")
def a14(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _rounded(reports.accuracy_by(rows, ["o_orderstatus", "o_orderpriority", "c_mktsegment"], F.col("o_totalprice") > 250000))


@query("A15_summary_by_type", """
WITH r AS (SELECT event_type AS t, CASE WHEN value > 50 THEN 1.0 ELSE 0 END AS em, CASE WHEN user_id % 4 <> 0 THEN value / 500 END AS f1, CASE WHEN user_id % 3 <> 0 THEN value / 400 END AS judge FROM events)
SELECT t AS qa_type, count(*) AS n, round(avg(em), 4) AS em, round(coalesce(avg(f1), 0), 4) AS f1, round(avg(judge), 4) AS judge, round(avg(CASE WHEN judge >= 0.5 THEN 1 WHEN judge < 0.5 THEN 0 END), 4) AS accuracy FROM r GROUP BY t
UNION ALL SELECT 'overall', count(*), round(avg(em), 4), round(avg(coalesce(f1, 0)), 4), round(avg(judge), 4), round(avg(CASE WHEN judge >= 0.5 THEN 1 WHEN judge < 0.5 THEN 0 END), 4) FROM r""")
def a15(spark, sf):
    v, u = F.col("value"), F.col("user_id")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("qa_type"), (v > 50).cast("double").alias("em"), F.when(u % 4 != 0, v / 500).alias("f1"), F.when(u % 3 != 0, v / 400).alias("judge"))
    return _rounded(reports.qa_summary(rows, "qa_type", "em", "f1", "judge"))


@query("A16_leaderboard", """
SELECT o_orderpriority, max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS "F", max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS "O", max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def a16(spark, sf):
    return metrics.leaderboard(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "o_totalprice", "o_orderkey")


@query("A17_agreement", """
WITH s AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS rate, avg(quality) AS p, avg(toxic) AS q, corr(quality, toxic) AS pearson FROM labels)
SELECT n, round(rate, 4) AS rate, round((rate - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))), 4) AS kappa, round(pearson, 4) AS pearson FROM s""")
def a17(spark, sf):
    return _rounded(metrics.agreement(table(spark, sf, "labels"), "quality", "toxic"))


@query("A18_difficulty", """
WITH a AS (SELECT l_orderkey, avg(l_quantity / 50) AS acc FROM lineitem GROUP BY 1)
SELECT round(avg(acc), 4) AS mean, round(var_pop(acc), 4) AS variance, round(stddev_pop(acc), 4) AS std, round(stddev_pop(acc) / avg(acc), 4) AS cv FROM a""")
def a18(spark, sf):
    return _rounded(reports.difficulty(table(spark, sf, "lineitem").withColumn("acc", F.col("l_quantity") / 50), "l_orderkey", "acc"))


_BINS = "CASE WHEN n_chars < 500 THEN '<500' WHEN n_chars < 1000 THEN '500-1K' WHEN n_chars < 4000 THEN '1K-4K' WHEN n_chars < 16000 THEN '4K-16K' ELSE '16K+' END"


@query("A19_stats_by_bin", f"""
SELECT lang, bin, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 4) AS avg FROM (SELECT *, {_BINS} AS bin FROM documents) GROUP BY CUBE (lang, bin)""")
def a19(spark, sf):
    bins = [(500, "<500"), (1000, "500-1K"), (4000, "1K-4K"), (16000, "4K-16K")]
    rows = table(spark, sf, "documents").select("lang", "n_chars", reports.binned(F.col("n_chars"), bins, "16K+").alias("bin"))
    return _rounded(reports.stats_by(rows, "lang", "bin", "n_chars"))


@query("A20_array_stats", """
SELECT label, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS std, round(min(s), 4) AS min, round(max(s), 4) AS max, count(*) AS size FROM (SELECT label, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings) GROUP BY label""")
def a20(spark, sf):
    s = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _rounded(reports.array_stats(table(spark, sf, "embeddings").select("label", s.alias("s")), "label", "s"))


@query("A21_pass_at_k", """
SELECT l_orderkey, n, c, round(CASE WHEN n - c < 2 THEN 1 ELSE 1 - (n - c) * (n - c - 1.0) / (n * (n - 1)) END, 6) AS pass_at_k FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)""")
def a21(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("ok", F.col("l_returnflag") == "R")
    return _rounded(metrics.pass_at_k(rows, "l_orderkey", "ok", 2), 6)


@query("A22_suite_table", """
SELECT event_type AS suite, count(*) AS n, count(*) FILTER (value > 60) AS passed, round(avg(CASE WHEN value > 60 THEN 1 ELSE 0 END), 4) AS pass_at_1, count(*) FILTER (user_id % 11 = 0) AS length_limit,
  count(*) FILTER (user_id % 13 = 0) AS errors, round(avg(CASE WHEN user_id % 5 <> 0 THEN value END), 4) AS mean_tokens FROM events GROUP BY 1""")
def a22(spark, sf):
    u, v = F.col("user_id"), F.col("value")
    rows = table(spark, sf, "events").withColumnRenamed("event_type", "suite")
    return _rounded(reports.suite_table(rows, "suite", v > 60, u % 11 == 0, u % 13 == 0, F.when(u % 5 != 0, v)))


@query("A23_speed_comparison", """
WITH s AS (SELECT event_type, avg(value) AS mean, median(value) AS median, count(*) * 3600 / sum(value) AS per_hour, sum(user_id) / sum(value) AS tokens_s FROM events GROUP BY 1)
SELECT event_type, round(mean, 4) AS mean, round(median, 4) AS median, round(per_hour, 4) AS per_hour, round(tokens_s, 4) AS tokens_s, round(mean / (SELECT mean FROM s WHERE event_type = 'view'), 4) AS ratio FROM s""")
def a23(spark, sf):
    return _rounded(reports.speed_comparison(table(spark, sf, "events"), "event_type", "value", "user_id", "view"))


@query("A24_score_delta", """
WITH a AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS acc FROM orders GROUP BY ALL)
SELECT a.p AS suite, a.y AS year, round((a.acc - b.acc) * 100, 4) AS delta_pp FROM a JOIN a b ON a.p = b.p AND a.y = b.y + 1""")
def a24(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("suite"), F.year("o_orderdate").alias("year"), "o_orderstatus")
    return _rounded(reports.score_delta(rows, "suite", "year", F.col("o_orderstatus") == "F"))


@query("A25_cluster_profile", """
WITH c AS (SELECT label, vec_id % 17 AS scenario, count(*) AS n FROM embeddings GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, scenario) AS rk, sum(n) OVER (PARTITION BY label) AS size FROM c)
SELECT label, scenario, n, rk AS rank, CAST(size AS BIGINT) AS size FROM r WHERE rk <= 10""")
def a25(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 17).alias("scenario"))
    return reports.cluster_profile(rows, "label", "scenario")


@query("A26_upper_median", """
SELECT count(*) AS rows, max(n_chars) AS max, list_sort(list(n_chars))[CAST(count(*) // 2 + 1 AS INT)] AS upper_median FROM documents""")
def a26(spark, sf):
    return metrics.upper_median(table(spark, sf, "documents").select("n_chars"), "n_chars", "n_chars")


@query("A27_manifest_stats", """
SELECT lang, count(*) AS rows, count(*) FILTER (contains(text, '###')) AS functional, count(*) FILTER (NOT contains(text, '###')) AS stdin, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang""")
def a27(spark, sf):
    return _rounded(reports.manifest_stats(table(spark, sf, "documents"), "lang", F.contains("text", F.lit("###")), "n_chars"))


@query("A28_table_checksum", """
SELECT md5(string_agg(substr(md5(concat_ws(',', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))), 1, 5), '' ORDER BY n_nationkey)) AS checksum FROM nation""")
def a28(spark, sf):
    return metrics.table_checksum(table(spark, sf, "nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])


@query("A29_skill_rates", """
WITH k AS (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'absent']) AS skill),
e AS (SELECT DISTINCT event_id, unnest([event_type, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'click' END]) AS skill, value > 50 AS ok FROM events)
SELECT skill, count(event_id) AS n, round(coalesce(avg(CASE WHEN ok THEN 1 WHEN NOT ok THEN 0 END), -1), 4) AS rate FROM k LEFT JOIN e USING (skill) GROUP BY skill""")
def a29(spark, sf):
    skills = F.array("event_type", F.when(F.col("user_id") % 2 == 0, "view").otherwise("click"))
    rows = table(spark, sf, "events").select(skills.alias("skills"), (F.col("value") > 50).alias("ok"))
    known = spark.createDataFrame([(s,) for s in ("view", "click", "purchase", "signup", "error", "absent")], "skill string")
    return _rounded(metrics.skill_rates(rows, "skills", "ok", known))


_CONTRIBUTION = """
p AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS k, avg(value) AS base, avg(value) FILTER (event_id % 3 = 0) AS w FROM events GROUP BY ALL),
c AS (SELECT user_id, coalesce(avg(CASE WHEN n >= 2 AND k > 0 AND k < n THEN (w - base) * k / n END), 0) AS contribution, CAST(sum(k) AS BIGINT) AS selected FROM p GROUP BY 1)"""


def _contribution(spark, sf):
    rows = table(spark, sf, "events").withColumn("chosen", F.col("event_id") % 3 == 0)
    return metrics.memory_contribution(rows, "user_id", "event_type", "chosen", "value")


@query("A30_memory_contribution", f"WITH {_CONTRIBUTION} SELECT user_id, round(contribution, 4) AS contribution, selected FROM c")
def a30(spark, sf):
    return _rounded(_contribution(spark, sf))


@query("A31_memory_score", f"""
WITH {_CONTRIBUTION}, t AS (SELECT *, CASE user_id % 5 WHEN 0 THEN 'skill' WHEN 1 THEN 'tip' WHEN 2 THEN 'tool' WHEN 3 THEN 'trajectory' ELSE 'other' END AS tier FROM c)
SELECT user_id, tier, round(CASE tier WHEN 'skill' THEN 1.0 WHEN 'tip' THEN 0.8 WHEN 'tool' THEN 1.2 WHEN 'trajectory' THEN 0.9 ELSE 1.0 END * (1 - 1 / sqrt(1 + selected)) * contribution, 4) AS score FROM t""")
def a31(spark, sf):
    m = F.col("user_id") % 5
    tier = F.when(m == 0, "skill").when(m == 1, "tip").when(m == 2, "tool").when(m == 3, "trajectory").otherwise("other")
    return _rounded(metrics.memory_score(_contribution(spark, sf).withColumn("tier", tier), "tier").select("user_id", "tier", "score"))


@query("A32_selector_metrics", """
WITH s AS (SELECT user_id, list(DISTINCT event_id % 13) FILTER (event_type = 'view') AS g, list(DISTINCT event_id % 13) FILTER (event_type = 'click') AS p FROM events GROUP BY 1),
r AS (SELECT coalesce(list_sort(g), []) AS g, coalesce(list_sort(p), []) AS p FROM s),
m AS (SELECT g, p, len(list_intersect(g, p)) AS i, p[1:3] AS t, len(list_intersect(g, p[1:3])) AS ik FROM r),
q AS (SELECT g, p, coalesce(i / nullif(len(p), 0), 0) AS pr, coalesce(i / nullif(len(g), 0), 0) AS re, coalesce(ik / nullif(len(t), 0), 0) AS pk, coalesce(ik / nullif(len(g), 0), 0) AS rk FROM m)
SELECT count(*) AS count, round(avg(CASE WHEN g = p THEN 1 ELSE 0 END), 4) AS exact_set_match, round(avg(pr), 4) AS precision, round(avg(re), 4) AS recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 4) AS f1,
  round(avg(pk), 4) AS p_at_k, round(avg(rk), 4) AS r_at_k, round(avg(coalesce(2 * pk * rk / nullif(pk + rk, 0), 0)), 4) AS f1_at_k FROM q""")
def a32(spark, sf):
    ids = lambda t: F.array_sort(F.collect_set(F.when(F.col("event_type") == t, F.col("event_id") % 13)))
    rows = table(spark, sf, "events").groupBy("user_id").agg(ids("view").alias("gold"), ids("click").alias("pred"))
    return _rounded(metrics.selector_metrics(rows, "gold", "pred", 3))


@query("A33_dropped_merge", """
SELECT event_type, CAST(sum(user_id) AS BIGINT) AS dropped, round(sum(value * user_id) / sum(user_id), 4) AS mean, max(value) AS max, min(value) AS min FROM events GROUP BY 1""")
def a33(spark, sf):
    return _rounded(reports.merged_drops(table(spark, sf, "events"), "event_type", "user_id", "value"))


@query("A34_imbalance", """
WITH b AS (SELECT doc_id % 8 AS bucket, sum(n_chars) AS s FROM documents GROUP BY 1)
SELECT CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, CAST(max(s) - min(s) AS BIGINT) AS minmax_diff, round(avg(s), 4) AS mean FROM b""")
def a34(spark, sf):
    return _rounded(reports.imbalance(table(spark, sf, "documents").withColumn("bucket", F.col("doc_id") % 8), "bucket", "n_chars"))


@query("A35_multiset_equality", """
SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)) AS only_a, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders)) AS only_b""")
def a35(spark, sf):
    return metrics.same_rows(table(spark, sf, "orders").select("o_custkey"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")))


@query("A36_collect_result", """
SELECT count(*) FILTER (user_id % 4 = 0) AS collected, count(*) FILTER (user_id % 4 = 1) AS skipped, count(*) FILTER (user_id % 4 = 2) AS dropped, count(*) FILTER (user_id % 4 = 3) AS failed,
  round(avg(value) FILTER (user_id % 4 = 0), 4) AS mean_reward, round(avg(CASE WHEN value > 25 THEN 1 ELSE 0 END) FILTER (user_id % 4 = 0), 4) AS success_rate FROM events""")
def a36(spark, sf):
    m, v = F.col("user_id") % 4, F.col("value")
    outcomes = {n: m == i for i, n in enumerate(("collected", "skipped", "dropped", "failed"))}
    return _rounded(reports.collect_result(table(spark, sf, "events"), outcomes, "value", v > 25))


@query("A37_distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def a37(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("A38_inference_totals", """
WITH l AS (SELECT user_id % 40 AS request, max_by(user_id, event_id) AS prompt, max_by(value, event_id) AS generated FROM events GROUP BY 1)
SELECT count(*) AS requests, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, round(sum(generated), 4) AS generated_tokens, round(count(*) / 60.0, 4) AS samples_s, round(sum(generated) / 60.0, 4) AS tokens_s FROM l""")
def a38(spark, sf):
    rows = table(spark, sf, "events").withColumn("request", F.col("user_id") % 40)
    return _rounded(reports.inference_totals(rows, "request", "event_id", "user_id", "value", 60.0))


@query("A39_distributed_mean", """
SELECT event_type, round(coalesce(sum(s) / nullif(sum(c), 0), -1), 4) AS mean FROM (SELECT event_type, user_id % 8 AS rank, sum(value) FILTER (value > 200) AS s, count(*) FILTER (value > 200) AS c FROM events GROUP BY ALL) GROUP BY 1""")
def a39(spark, sf):
    rows = table(spark, sf, "events").withColumn("rank", F.col("user_id") % 8)
    return _rounded(reports.distributed_mean(rows, "event_type", "rank", "value", F.col("value") > 200))


@query("A40_tail_ratio", """
WITH q AS (SELECT quantile_cont(value, 0.9) AS cut, min(value) AS min, max(value) AS max FROM events)
SELECT round(avg(CASE WHEN value > cut THEN 1 ELSE 0 END), 4) AS tail_ratio, any_value(min) AS min, any_value(max) AS max FROM events, q""")
def a40(spark, sf):
    return _rounded(reports.tail_ratio(table(spark, sf, "events"), "value"))
