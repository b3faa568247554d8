"""Queries of the streaming editions, and of what is left of the extension points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.functions import extend, payloads
from braidwork.functions import text as tx
from braidwork.operators import packing
from braidwork.sources import files
from braidwork.streaming import buffer, run

from .packing import _CAP, _next_fit_sql
from .registry import query, table


@query("B04_stream_packing", _next_fit_sql("CAST(doc_id % 4 AS BIGINT)"))
def b04(spark, sf):
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("shard"), "doc_id", "n_chars")
    half = docs.agg((F.max("doc_id") / 2).alias("h")).first()["h"] or 0
    packed = run.run_increments([docs.filter(F.col("doc_id") <= half), docs.filter(F.col("doc_id") > half)], lambda s: buffer.pack_stream(s, "shard", "doc_id", "n_chars", _CAP))
    return packed.select("shard", "ordinal", "value", "pack")


@query("B04_stream_bins")
def b04_bins(spark, sf):
    """Best fit of every 32 documents of a shard, in two increments, and an end of each shard."""
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("shard"), "doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    half, top = docs.agg((F.max("doc_id") / 2), F.max("doc_id")).first()
    ends = docs.select("shard").distinct().select("shard", F.lit((top or 0) + 1).alias("doc_id"), F.lit(None).cast("long").alias("n_chars"))
    increments = [docs.filter(F.col("doc_id") <= (half or 0)), docs.filter(F.col("doc_id") > (half or 0)), ends]
    return run.run_increments(increments, lambda s: buffer.bin_stream(s, "shard", "doc_id", "n_chars", 40_000, 32)).select("shard", "ordinal", "value", "pack")


@query("B04_cyclic_packing")
def b04_cyclic(spark, sf):
    """The first 60 packs of each of four shards of documents, which begin again when they are through."""
    return packing.cyclic_packs(table(spark, sf, "documents"), F.col("doc_id") % 4, "doc_id", "n_chars", 40_000, 60)


@query("R11_stream_packing", "SELECT CAST(doc_id % 4 AS BIGINT) AS shard, count(*) AS items, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1")
def r11(spark, sf):
    return b04(spark, sf).groupBy("shard").agg(F.count("*").alias("items"), F.sum("value").alias("total"))


@query("R01_stream_queue", "SELECT event_type AS queue, least(count(*), 100) AS kept, count(*) AS produced, greatest(count(*) - 100, 0) AS dropped FROM events GROUP BY 1")
def r01(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id")
    half = rows.agg((F.max("event_id") / 2).alias("h")).first()["h"] or 0
    out = run.run_increments([rows.filter(F.col("event_id") <= half), rows.filter(F.col("event_id") > half)], lambda s: buffer.bounded_queue(s, "event_type", "event_id", 100), mode="update", rocksdb=True)
    return out.groupBy("queue").agg(*[F.max_by(c, "produced").alias(c) for c in ("kept", "dropped")], F.max("produced").alias("produced"))


_REPLAY = """l AS (SELECT 'b' || user_id % 4 AS buffer, 'u' || user_id AS uid, event_id % 4 AS member, event_id AS line, user_id % 20 AS step, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failure' ELSE 'finished' END AS status FROM events),
s AS (SELECT buffer, uid, member, max_by(status, line) AS status, min_by(step, line) AS step FROM l GROUP BY ALL),
g AS (SELECT buffer, uid, 20 - min(step) + 1 AS span, bool_and(status IN ('finished', 'failure')) AS done FROM s GROUP BY ALL)"""


def _replay_rows(spark, sf):
    """News of four buffers, and a request for four groups of each behind all of it."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "running").when(kind == "error", "failure").otherwise("finished")
    none = F.lit(None).cast("long")
    news = table(spark, sf, "events").select(F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("buffer"), F.col("event_id").cast("long").alias("line"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"), (F.col("event_id") % 4).cast("long").alias("member"), status.alias("status"), (F.col("user_id") % 20).cast("long").alias("step"), none.alias("request"), none.alias("size"))
    text = F.lit(None).cast("string")
    asks = news.groupBy("buffer").agg((F.max("line") + 1).alias("line")).select("buffer", "line", text.alias("uid"), none.alias("member"), text.alias("status"), F.lit(20).cast("long").alias("step"), F.lit(1).cast("long").alias("request"), F.lit(4).cast("long").alias("size"))
    return news, asks


@query("R05_stream_sample", f"""
WITH {_REPLAY}, c AS (SELECT *, CASE WHEN span > 18 THEN 'dropped' ELSE 'sampled' END AS action FROM g WHERE done),
k AS (SELECT *, row_number() OVER (PARTITION BY buffer, action ORDER BY span DESC, uid) AS n, count(*) OVER (PARTITION BY buffer, action) AS many FROM c)
SELECT k.buffer, k.action, k.uid, s.member, s.status, k.span FROM k JOIN s USING (buffer, uid) WHERE action = 'dropped' OR many >= 4 AND n <= 4""")
def r05(spark, sf):
    """Three increments of news, the last with the requests; every increment is a restart from the checkpoint."""
    news, asks = _replay_rows(spark, sf)
    third = news.agg((F.max("line") / 3).alias("h")).first()["h"] or 0
    parts = [news.filter(F.col("line") <= third), news.filter((F.col("line") > third) & (F.col("line") <= 2 * third)), news.filter(F.col("line") > 2 * third).unionByName(asks)]
    out = run.run_increments(parts, lambda s: buffer.replay_stream(s, "drop", 18), rocksdb=True)
    return out.select("buffer", "action", "uid", "member", "status", "span")


_STARTS = "l AS (SELECT event_id // 2 AS task, ts, CASE WHEN event_id % 2 = 0 THEN 'started' ELSE 'complete' END AS status, value FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0)"


@query("R07_stream_merge", f"""
WITH {_STARTS}, s AS (SELECT * FROM l WHERE status = 'started'), c AS (SELECT * FROM l WHERE status = 'complete')
SELECT coalesce(s.task, c.task) AS task, coalesce(c.value, s.value) AS value, c.task IS NOT NULL AS complete FROM s FULL JOIN c ON s.task = c.task AND c.ts >= s.ts AND c.ts <= s.ts + INTERVAL 10 DAYS""")
def r07(spark, sf):
    """Starts and ends of a log in three increments, then one of either in the year 2200 that tell the stream that all is through."""
    e = table(spark, sf, "events").filter("event_id % 2 = 0 or event_id % 3 = 0")
    rows = e.select(F.floor(F.col("event_id") / 2).cast("long").alias("task"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 2 == 0, "started").otherwise("complete").alias("status"), "value", F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("part"))
    end = spark.createDataFrame([(-1, "started"), (-1, "complete")], "task long, status string").select("task", F.to_timestamp(F.lit("2200-01-01")).alias("at"), "status", F.lit(0.0).alias("value"))
    out = run.run_increments([*(rows.filter(F.col("part") == i).drop("part") for i in range(3)), end, end], lambda s: buffer.reconcile_stream(s, "task", "at", "status", "value", "10 DAYS", "2000 days"))
    return out.filter("task >= 0").select("task", "value", "complete")


@query("R10_stream_shuffle", """
WITH RECURSIVE d AS (SELECT CAST(doc_id % 4 AS BIGINT) AS shard, CAST(doc_id AS BIGINT) AS i, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS k FROM documents),
r(shard, k, held, place, i) AS (SELECT DISTINCT shard, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT), CAST(NULL AS BIGINT) FROM d
  UNION ALL SELECT shard, k, CASE WHEN spot IS NULL THEN list_append(held, i) ELSE list_transform(held, lambda x, j: CASE WHEN j = spot THEN i ELSE x END) END, CASE WHEN spot IS NULL THEN -1 ELSE k - 17 END, held[spot] FROM (
    SELECT d.shard, d.k, r.held, d.i, CASE WHEN len(r.held) = 16 THEN CAST('0x' || substr(md5('42|' || d.shard || '|' || (d.k - 17)), 1, 8) AS BIGINT) % 16 + 1 END AS spot FROM r JOIN d ON d.shard = r.shard AND d.k = r.k + 1)),
l AS (SELECT shard, k, unnest(held) AS i FROM r QUALIFY k = max(k) OVER (PARTITION BY shard))
SELECT shard, place, i AS ordinal FROM r WHERE place >= 0
UNION ALL SELECT shard, greatest(k - 16, 0) + row_number() OVER (PARTITION BY shard ORDER BY substr(md5('42|' || shard || '|rest|' || i), 1, 8), i) - 1, i FROM l""")
def r10_shuffle(spark, sf):
    """Documents of four shards through reservoirs of 16, in two increments and an end of each shard."""
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("line"), F.col("doc_id").cast("long").alias("ordinal"))
    half, top = docs.agg((F.max("line") / 2), F.max("line")).first()
    ends = docs.select("shard").distinct().select("shard", F.lit((top or 0) + 1).alias("line"), F.lit(None).cast("long").alias("ordinal"))
    parts = [docs.filter(F.col("line") <= (half or 0)), docs.filter(F.col("line") > (half or 0)), ends]
    return run.run_increments(parts, lambda s: buffer.shuffle_stream(s, "shard", "line", "ordinal", 16)).select("shard", "place", "ordinal")


@query("K08_metric_sink", "SELECT event_type AS name, round(sum(value), 3) AS total, count(*) AS n FROM events GROUP BY 1")
def k08(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    parts = [rows.filter(F.col("event_id") % 2 == i) for i in range(2)]
    return run.metric_sink(parts, "event_type", "value").withColumn("total", F.round("total", 3))


@query("E02_custom_source", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def e02(spark, sf):
    registry = files.Registry()
    registry.register("demo/by-region", lambda s, at: table(s, sf, "nation").filter(F.col("n_regionkey") == int(at.subsets[0])))
    return registry.load(spark, "by-region:1").select("n_nationkey", "n_name")


@query("E04_custom_score", "SELECT item_id, CASE WHEN length(text) % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM benchmark")
def e04(spark, sf):
    def compute_score(source, solution, truth):
        return [float(len(s) % t == 0) for _, s, t in zip(source, solution, truth)]

    score = extend.batched_reward(compute_score)
    return table(spark, sf, "benchmark").select("item_id", score(F.lit("bench"), "text", F.lit(2)).alias("score"))


@query("E05_custom_sampler", "SELECT doc_id FROM documents ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def e05(spark, sf):
    return extend.SAMPLERS.get("hashed")(table(spark, sf, "documents").select("doc_id"), 100, "doc_id", 7)


@query("E07_replay_sampler", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 20")
def e07(spark, sf):
    groups = table(spark, sf, "events").groupBy(F.col("user_id").alias("uid")).agg(F.min("event_id").alias("step"))
    return extend.REPLAY.get("oldest")().sample(groups, 20).select(F.col("uid").alias("user_id"), F.col("step").alias("event_id"))


@query("E10_batched_scores", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM benchmark")
def e10(spark, sf):
    def scores(sources, solutions, truths, extras):
        return [1.0 if tx.latex_equal(tx.boxed(s), t) else e for s, t, e in zip(solutions, truths, extras)]

    solution = F.concat(F.lit("so \\boxed{"), (F.col("item_id") % 2).cast("string"), F.lit("}"))
    return table(spark, sf, "benchmark").select("item_id", extend.batched_reward(scores)(F.lit("m"), solution, F.lit("0"), F.lit(0.0)).alias("score"))


@query("C11_rewrite", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 1000, 'new'")
def c11(spark, sf):
    """Tables are immutable: insert, update and delete give a new table."""
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), "n_name").filter("n_nationkey <> 5")
    rows = rows.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "renamed").otherwise(F.col("n_name")))
    return rows.unionByName(spark.createDataFrame([(1000, "new")], "n_nationkey long, n_name string"))


_NEXT_WORDS = """p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS x, list_filter(regexp_split_to_array(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '\\s+'), lambda w: w <> '') AS y FROM conversations),
q AS (SELECT * FROM p WHERE len(x) > 0 AND len(y) > 0)"""


def _rouge_sql(n):
    grams = lambda c: f"list_transform(range(1, greatest(len({c}) - {n - 2}, 1)), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"
    return f"""u{n} AS (SELECT conv_id, turn, w, sum(i) AS i, sum(j) AS j FROM (SELECT conv_id, turn, unnest({grams("x")}) AS w, 1 AS i, 0 AS j FROM q UNION ALL SELECT conv_id, turn, unnest({grams("y")}), 0, 1 FROM q) GROUP BY ALL),
c{n} AS (SELECT conv_id, turn, 2.0 * sum(least(i, j)) / sum(i + j) AS f FROM u{n} GROUP BY ALL)"""


@query("X35_rouge", f"""
WITH {_NEXT_WORDS}, {_rouge_sql(1)}, {_rouge_sql(2)}
SELECT conv_id, turn, round(coalesce(c1.f, 0), 6) AS rouge_1, round(coalesce(c2.f, 0), 6) AS rouge_2 FROM q LEFT JOIN c1 USING (conv_id, turn) LEFT JOIN c2 USING (conv_id, turn)""")
def x35(spark, sf):
    return x35_all(spark, sf).select("conv_id", "turn", F.round("rouge_1", 6).alias("rouge_1"), F.round("rouge_2", 6).alias("rouge_2"))


@query("X35_rouge_l_bleu")
def x35_all(spark, sf):
    """ROUGE and BLEU of a turn against the next, over words parted by white space; segmenters and stemmers of the usual libraries are not there."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    rows = table(spark, sf, "conversations").withColumn("next", nxt).select("conv_id", "turn", words("text").alias("x"), words("next").alias("y"))
    rows = rows.filter("size(x) > 0 and size(y) > 0").select("conv_id", "turn", payloads.overlaps_udf("x", "y").alias("o"))
    return rows.select("conv_id", "turn", "o.*")
