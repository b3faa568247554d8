"""Queries of packing, balancing, curation and the replay buffer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.operators import curation, packing, retrieval
from braidwork.streaming import buffer

from .registry import query, table

_CAP = 20_000


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", "lang")


def _next_fit_sql(shard):
    return f"""
WITH RECURSIVE d AS (SELECT {shard} AS shard, doc_id AS ordinal, n_chars AS value, row_number() OVER (PARTITION BY {shard} ORDER BY doc_id) AS k FROM documents),
r AS (SELECT shard, ordinal, value, k, CAST(0 AS BIGINT) AS pack, value AS held FROM d WHERE k = 1
  UNION ALL SELECT d.shard, d.ordinal, d.value, d.k, r.pack + CASE WHEN r.held >= {_CAP} OR r.held + d.value > {_CAP} THEN 1 ELSE 0 END, CASE WHEN r.held >= {_CAP} OR r.held + d.value > {_CAP} THEN d.value ELSE r.held + d.value END
  FROM r JOIN d ON d.shard = r.shard AND d.k = r.k + 1)
SELECT shard, ordinal, value, pack FROM r"""


@query("B01_next_fit", _next_fit_sql("CAST(doc_id // 100 AS BIGINT)"))
def b01(spark, sf):
    return packing.by_shard(_docs(spark, sf), F.floor(F.col("doc_id") / 100), "doc_id", "n_chars", lambda x: packing.next_fit(x, _CAP))


def _best_fit_sql(shard, items, cap):
    """Items longest first; rooms of the bins opened so far as a list."""
    return f"""
WITH RECURSIVE d AS (SELECT {shard} AS shard, doc_id AS ordinal, n_chars AS value, row_number() OVER (PARTITION BY {shard} ORDER BY n_chars DESC, doc_id) AS k FROM {items}),
r AS (SELECT shard, ordinal, value, k, CAST(1 AS BIGINT) AS bin, [CAST({cap} - value AS BIGINT)] AS rooms FROM d WHERE k = 1
  UNION ALL SELECT shard, ordinal, value, k, bin, CASE WHEN bin > len(rooms) THEN list_append(rooms, CAST({cap} - value AS BIGINT)) ELSE list_transform(rooms, lambda x, i: CASE WHEN i = bin THEN x - value ELSE x END) END
  FROM (SELECT d.shard, d.ordinal, d.value, d.k, r.rooms, CAST(coalesce(list_position(r.rooms, list_min(list_filter(r.rooms, lambda x: x >= d.value AND x > 0))), len(r.rooms) + 1) AS BIGINT) AS bin FROM r JOIN d ON d.shard = r.shard AND d.k = r.k + 1))
SELECT shard, ordinal, value, bin - 1 AS pack FROM r"""


@query("B02_bin_packing", _best_fit_sql("CAST(doc_id // 200 AS BIGINT)", "documents", 40_000))
def b02(spark, sf):
    return packing.by_shard(_docs(spark, sf), F.floor(F.col("doc_id") / 200), "doc_id", "n_chars", lambda x: packing.best_fit(x, 40_000))


@query("B02_carried_bins", f"""
WITH a AS ({_best_fit_sql("CAST(doc_id // 200 AS BIGINT)", "(SELECT * FROM documents WHERE doc_id % 200 < 100)", 40_000)}),
c AS (SELECT shard, max(pack) AS last, max(pack) FILTER (shard IS NOT NULL) AS n FROM a GROUP BY 1),
b AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 200 >= 100 UNION ALL SELECT ordinal, value FROM a JOIN c USING (shard) WHERE pack = last),
z AS ({_best_fit_sql("CAST(doc_id // 200 AS BIGINT)", "b", 40_000)})
SELECT shard, ordinal, value, pack FROM a JOIN c USING (shard) WHERE pack < last
UNION ALL SELECT shard, ordinal, value, pack + coalesce(last, 0) FROM z LEFT JOIN c USING (shard)""")
def b02_carried(spark, sf):
    """Shards of 200 in batches of 100; the last bin of the first batch is packed anew with the second."""
    docs = _docs(spark, sf)
    return packing.by_shard(docs, F.floor(F.col("doc_id") / 200), "doc_id", "n_chars", lambda x: packing.batched(x, 40_000, 100))


@query("B03_sharded_packing", _next_fit_sql("CAST(doc_id // 3000 AS BIGINT)"))
def b03(spark, sf):
    """Contiguous shards of 3000 rows, in batches of 1000 with the open pack carried."""
    return packing.by_shard(_docs(spark, sf), F.floor(F.col("doc_id") / 3000), "doc_id", "n_chars", lambda x: packing.batched(x, _CAP, strategy="sequential"))


@query("B05_workload", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS workload FROM documents")
def b05(spark, sf):
    return _docs(spark, sf).select("doc_id", packing.workload(F.col("n_chars")).alias("workload"))


def _difference_sql(values):
    """How far two partitions by differencing are apart: the two largest numbers of a list become their difference, again and again."""
    return f"""r(shard, l) AS (SELECT shard, list_reverse_sort({values}) FROM v GROUP BY shard
  UNION ALL SELECT shard, list_reverse_sort(list_append(l[3:], l[1] - l[2])) FROM r WHERE len(l) > 1),
x AS (SELECT shard, l[1] AS difference FROM r WHERE len(l) = 1)"""


@query("B06_differencing", f"""
WITH RECURSIVE v AS (SELECT CAST(doc_id // 50 AS BIGINT) AS shard, CAST(n_chars AS BIGINT) AS value FROM documents), {_difference_sql("list(value)")}
SELECT shard, count(*) AS items, CAST(sum(value) AS BIGINT) AS total, CAST(any_value(difference) AS BIGINT) AS difference FROM v JOIN x USING (shard) GROUP BY shard""")
def b06(spark, sf):
    parts = packing.by_shard(_docs(spark, sf), F.floor(F.col("doc_id") / 50), "doc_id", "n_chars", lambda x: packing.differencing(x, 2), "part")
    return _apart(parts)


def _apart(parts):
    sums = parts.groupBy("shard").agg(F.count("*").alias("items"), F.sum("value").alias("total"), F.sum(F.when(F.col("part") == 0, F.col("value")).otherwise(-F.col("value"))).alias("d"))
    return sums.select("shard", "items", "total", F.abs("d").alias("difference"))


@query("B06_equal_sizes", f"""
WITH RECURSIVE d AS (SELECT CAST(doc_id // 50 AS BIGINT) AS shard, CAST(n_chars AS BIGINT) AS value, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY n_chars, doc_id) - 1 AS k FROM documents),
v AS (SELECT shard, k // 2 AS p, max(value) - min(value) AS value, CAST(sum(value) AS BIGINT) AS s FROM d GROUP BY ALL), {_difference_sql("list(value)")}
SELECT shard, CAST(2 * count(*) AS BIGINT) AS items, CAST(sum(s) AS BIGINT) AS total, CAST(any_value(difference) AS BIGINT) AS difference, CAST(count(*) AS BIGINT) AS each FROM v JOIN x USING (shard) GROUP BY shard""")
def b06_equal(spark, sf):
    """Shards of an odd number are filled up with a copy of their largest row, which counts as an item and in the difference, not in the total."""
    parts = packing.equal_parts(_docs(spark, sf), F.floor(F.col("doc_id") / 50), "doc_id", "n_chars", 2)
    each = parts.groupBy("shard", "part").agg(F.count("*").alias("each")).select("shard", "each").distinct()
    total = parts.filter("not is_padding").groupBy("shard").agg(F.sum("value").alias("total"))
    return _apart(parts).drop("total").join(total, "shard").join(each, "shard").select("shard", "items", "total", "difference", "each")


_GREEDY = """d AS (SELECT conv_id AS shard, turn AS ordinal, CAST(length(text) AS BIGINT) AS value, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT shard, ordinal, value, k, CAST(0 AS BIGINT) AS part, value AS a, CAST(0 AS BIGINT) AS b FROM d WHERE k = 1
  UNION ALL SELECT d.shard, d.ordinal, d.value, d.k, CASE WHEN r.a <= r.b THEN 0 ELSE 1 END, r.a + CASE WHEN r.a <= r.b THEN d.value ELSE 0 END, r.b + CASE WHEN r.a <= r.b THEN 0 ELSE d.value END FROM r JOIN d ON d.shard = r.shard AND d.k = r.k + 1)"""


@query("B07_greedy", f"WITH RECURSIVE {_GREEDY} SELECT shard, ordinal, value, part FROM r")
def b07(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    return packing.by_shard(rows, F.col("conv_id"), "turn", "n", lambda x: packing.greedy(x, 2), "part")


@query("B08_balanced_partition", f"""
WITH RECURSIVE v AS (SELECT CAST(doc_id // 40 AS BIGINT) AS shard, 24576 * CAST(n_chars AS BIGINT) + CAST(n_chars AS BIGINT) * n_chars AS value FROM documents), {_difference_sql("list(value)")}
SELECT shard, CAST((sum(value) - any_value(difference)) / 2 AS BIGINT) AS smaller, CAST((sum(value) + any_value(difference)) / 2 AS BIGINT) AS larger FROM v JOIN x USING (shard) GROUP BY shard""")
def b08(spark, sf):
    rows = _docs(spark, sf).withColumn("load", packing.workload(F.col("n_chars").cast("long")))
    parts = packing.by_shard(rows, F.floor(F.col("doc_id") / 40), "doc_id", "load", lambda x: packing.balanced(x, 2), "part")
    sums = parts.groupBy("shard", "part").agg(F.sum("value").alias("s"))
    return sums.groupBy("shard").agg(F.min("s").alias("smaller"), F.max("s").alias("larger"))


_PARTS = "STRUCT(s BIGINT, n BIGINT, m BIGINT[])[]"


def _differencing_sql(equal):
    """CTEs from v (shard, i, load, k) on: `ranked` has the members i of each shard's partitions, these numbered by sum, then size, then members.

    A state is a list of partitions, its sums negated so that the list sorts; the two of widest spread merge, the first partition of one
    with the last of the other. With `equal`, states begin as k values of like size each, else as one value each.
    """
    starts = (
        f"SELECT shard, k, o // k AS c, CAST(list_sort(list({{'s': -load, 'n': -1, 'm': [i]}})) AS {_PARTS}) AS p FROM o GROUP BY ALL"
        if equal
        else f"SELECT shard, k, o AS c, CAST(list_concat([{{'s': -load, 'n': -1, 'm': [i]}}], list_transform(range(1, k), lambda j: {{'s': 0, 'n': 0, 'm': []}})) AS {_PARTS}) AS p FROM o"
    )
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY load, i) - 1 AS o FROM v),
b AS ({starts}),
r(shard, k, next, states) AS (
  SELECT shard, k, count(*), list_sort(list({{'sp': p[1].s - p[k].s, 'c': c, 'p': p}})) FROM b GROUP BY shard, k
  UNION ALL SELECT shard, k, next + 1, list_sort(list_append(states[3:], {{'sp': p[1].s - p[k].s, 'c': next, 'p': p}})) FROM (
    SELECT *, list_sort(list_transform(range(1, k + 1), lambda j: {{'s': states[1].p[j].s + states[2].p[k + 1 - j].s, 'n': states[1].p[j].n + states[2].p[k + 1 - j].n,
      'm': list_concat(states[1].p[j].m, states[2].p[k + 1 - j].m)}})) AS p FROM r WHERE len(states) > 1)),
ranked AS (SELECT shard, k, j - 1 AS rank, unnest(states[1].p[j].m) AS i FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM r WHERE len(states) = 1))"""


@query("B09_micro_batches", f"""
WITH RECURSIVE d AS (SELECT CAST(doc_id // 10 AS BIGINT) AS shard, doc_id AS i, CAST(n_chars AS BIGINT) AS value, count(*) OVER g AS rows, ceil(sum(n_chars) OVER g / 9000.0) AS enough FROM documents WINDOW g AS (PARTITION BY doc_id // 10)),
v AS (SELECT shard, i, value, 24576 * value + value * value AS load, CAST(greatest(1, least(rows, ceil(least(rows, enough) / 2) * 2)) AS BIGINT) AS k FROM d), {_differencing_sql(False)}
SELECT shard, i AS ordinal, value, CASE WHEN rank % 2 = 0 THEN (k + 1) // 2 - 1 - rank // 2 ELSE (k + 1) // 2 + rank // 2 END AS micro FROM v JOIN ranked USING (shard, k, i)""")
def b09(spark, sf):
    """Every document's micro-batch: those of the largest workload stand in the middle of their batch, small ones first and last."""
    rows = _docs(spark, sf).withColumn("g", F.floor(F.col("doc_id") / 10))
    return packing.micro_batches(rows, "g", "doc_id", "n_chars", 9_000, divided_by=2)


@query("B10_uid_groups", f"""
WITH RECURSIVE u AS (SELECT CAST(o_custkey AS BIGINT) AS shard, l_orderkey AS i, CAST(sum(24576 * CAST(l_quantity AS BIGINT) + CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS load FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
n AS (SELECT shard, count(*) AS n FROM u GROUP BY shard),
v AS (SELECT shard, i, load, coalesce(list_filter(range(2, n + 1), lambda d: n % d = 0)[1], 1) AS k FROM u JOIN n USING (shard)), {_differencing_sql(True)}
SELECT shard, i AS uid, load AS workload, rank AS part FROM v JOIN ranked USING (shard, k, i)""")
def b10(spark, sf):
    """Every customer's orders in partitions of equally many orders: as many as the least number above one that divides them."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("n"))
    rows = lines.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return packing.uid_partitions(rows, F.col("o_custkey"), "l_orderkey", "l_orderkey", "n", packing.least_divisor)


@query("B11_restore_order", f"""
WITH RECURSIVE {_GREEDY}
SELECT shard, ordinal, value, row_number() OVER (PARTITION BY shard ORDER BY ordinal) - 1 AS place, row_number() OVER (PARTITION BY shard ORDER BY part, ordinal) - 1 AS source FROM r""")
def b11(spark, sf):
    return packing.restored(packing.arranged(b07(spark, sf), "shard", "part", "ordinal"), "shard", "ordinal").select("shard", "ordinal", "value", "place", "source")


@query("B12_pad_to_multiple", """
WITH n AS (SELECT (-count(*) % 64 + 64) % 64 AS short FROM documents)
SELECT doc_id, n_chars, false AS is_padding FROM documents UNION ALL SELECT doc_id, n_chars, true FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents), n WHERE i <= short""")
def b12(spark, sf):
    return packing.padded(_docs(spark, sf).select("doc_id", "n_chars"), 64, "doc_id")


@query("B13_token_bins", "SELECT CASE WHEN n_chars <= 4096 THEN '4K' WHEN n_chars <= 8192 THEN '8K' WHEN n_chars <= 16384 THEN '16K' WHEN n_chars <= 32768 THEN '32K' WHEN n_chars <= 65536 THEN '64K' ELSE '128K' END AS bin, count(*) AS n FROM documents GROUP BY 1")
def b13(spark, sf):
    return _docs(spark, sf).groupBy(packing.token_bin(F.col("n_chars")).alias("bin")).agg(F.count("*").alias("n"))


@query("B14_fixed_length", "SELECT o_custkey, list_resize(o[1:4], 4, -1) AS ids FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS o FROM orders GROUP BY 1)")
def b14(spark, sf):
    ids = F.array_sort(F.collect_list("o_orderkey"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(packing.fixed_length(ids, 4, -1).alias("ids"))


@query("B15_kmeans")
def b15(spark, sf):
    return retrieval.clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", 10).select("vec_id", "cluster")


_ROUNDS = "(SELECT user_id AS task, event_id AS round, round(value / 500, 6) AS score, event_type = 'purchase' AND value > 150 AS complete, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors FROM events)"


@query("W09_choose_round", f"""
WITH r AS (SELECT *, round(score - lag(score) OVER w, 12) AS gain, lag(round) OVER w AS source, first_value(score) OVER w AS base, min(round) OVER (PARTITION BY task) AS first_round FROM {_ROUNDS} WINDOW w AS (PARTITION BY task ORDER BY round)),
d AS (SELECT task, min(round) FILTER (complete AND errors = 0) AS done, any_value(first_round) AS first_round FROM r GROUP BY 1),
b AS (SELECT * FROM (SELECT task, source, round AS target, gain, row_number() OVER (PARTITION BY task ORDER BY gain DESC, round) AS k FROM r WHERE errors = 0 AND gain > 0 AND score > base + 1e-9) WHERE k = 1)
SELECT task, CASE WHEN done = first_round THEN 'complete_first_try' WHEN done IS NOT NULL THEN 'complete_after_refine' ELSE 'improved_partial' END AS kind,
  CASE WHEN done IS NULL THEN source END AS source, coalesce(done, target) AS target, CASE WHEN done IS NULL THEN gain END AS delta FROM d LEFT JOIN b USING (task) WHERE done IS NOT NULL OR target IS NOT NULL""")
def w09(spark, sf):
    e = table(spark, sf, "events")
    done = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    rows = e.select(F.col("user_id").alias("task"), F.col("event_id").alias("round"), F.round(F.col("value") / 500, 6).alias("score"), done.alias("complete"), (F.col("event_type") == "error").cast("int").alias("errors"))
    return curation.choose_round(rows, "task", "round", "score", "complete", "errors")


@query("W10_best_per_task", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, value DESC, event_id) AS n FROM events) WHERE n = 1")
def w10(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").withColumn("priority", F.when(kind == "purchase", 0).when(kind == "signup", 1).otherwise(2))
    return curation.best_per_task(rows, "user_id", "priority", "value", "event_id").select("user_id", "event_id", "event_type")


# ---- replay buffer: a status log by uid (user) and member (event id mod 4)

_LOG = "(SELECT 'u' || user_id AS uid, event_id % 4 AS member, event_id AS line, user_id % 20 AS step, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failure' ELSE 'finished' END AS status, value FROM events)"


def _log(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "view", "running").when(kind == "error", "failure").otherwise("finished")
    return table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"), (F.col("event_id") % 4).alias("member"), F.col("event_id").alias("line"), (F.col("user_id") % 20).alias("step"), status.alias("status"), "value")


_STATUS = f"s AS (SELECT uid, member, max_by(status, line) AS status, min_by(step, line) AS step FROM {_LOG} GROUP BY ALL), g AS (SELECT uid, min(step) AS step FROM s GROUP BY uid HAVING bool_and(status IN ('finished', 'failure')))"


@query("R01_bounded_queue", "SELECT event_type, event_id, p AS produced, greatest(p - 100, 0) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n, count(*) OVER (PARTITION BY event_type) AS p FROM events) WHERE n <= 100")
def r01(spark, sf):
    return buffer.keep_newest(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 100)


@query("R02_status_machine", f"WITH {_STATUS} SELECT uid, step FROM g")
def r02(spark, sf):
    return buffer.sampleable(buffer.latest_status(_log(spark, sf), ["uid", "member"], "status", "line"), "uid")


@query("R03_staleness", f"WITH {_STATUS} SELECT uid, member, 20 - step + 1 AS span FROM s WHERE 20 - step + 1 <= 8")
def r03(spark, sf):
    return buffer.fresh(buffer.latest_status(_log(spark, sf), ["uid", "member"], "status", "line"), 20, 8).select("uid", "member", "span")


@query("R04_wait_gate", f"WITH {_STATUS} SELECT coalesce(bool_or(status = 'running' AND 20 - step + 1 >= 15), false) AS wait FROM s")
def r04(spark, sf):
    return buffer.must_wait(buffer.latest_status(_log(spark, sf), ["uid", "member"], "status", "line"), 20, 15)


@query("R05_sample_oldest", f"WITH {_STATUS}, c AS (SELECT uid FROM g WHERE 20 - step + 1 <= 18 ORDER BY step, uid LIMIT 16) SELECT s.uid, member, status FROM s JOIN c USING (uid)")
def r05(spark, sf):
    status = buffer.latest_status(_log(spark, sf), ["uid", "member"], "status", "line")
    groups = buffer.fresh(buffer.sampleable(status, "uid"), 20, 18)
    return buffer.take_oldest(groups, status, "uid", 16)[0].select("uid", "member", "status")


@query("R06_pool_refill", """
WITH RECURSIVE t AS (SELECT count(*) AS total FROM customer), e AS (SELECT CAST(user_id % 6 AS BIGINT) AS step, CAST(count(DISTINCT user_id) AS BIGINT) AS done FROM events GROUP BY 1),
r AS (SELECT CAST(-1 AS BIGINT) AS step, CAST(0 AS BIGINT) AS admitted, CAST(0 AS BIGINT) AS queued, total AS remaining FROM t
  UNION ALL SELECT r.step + 1, least(greatest(32 - queued, 0), remaining), queued + least(greatest(32 - queued, 0), remaining) - least(done, queued + least(greatest(32 - queued, 0), remaining)), remaining - least(greatest(32 - queued, 0), remaining) FROM r JOIN e ON e.step = r.step + 1)
SELECT step, admitted, queued FROM r WHERE step >= 0""")
def r06(spark, sf):
    """A pool of 32 refilled from the customers, from which each step takes as many as it has users."""
    done = table(spark, sf, "events").groupBy((F.col("user_id") % 6).alias("step")).agg(F.count_distinct("user_id").alias("done"))
    return buffer.refilled(table(spark, sf, "customer"), done, "step", "done", 32)


@query("R07_reconcile", f"SELECT uid, min(line) AS first_line, coalesce(max_by(value, line) FILTER (status = 'complete'), max_by(value, line)) AS value, bool_or(status = 'complete') AS complete FROM (SELECT uid, line, value, CASE WHEN status = 'finished' THEN 'complete' ELSE 'started' END AS status FROM {_LOG}) GROUP BY uid")
def r07(spark, sf):
    rows = _log(spark, sf).withColumn("status", F.when(F.col("status") == "finished", "complete").otherwise("started"))
    return buffer.reconcile(rows, "uid", "line", "status")


@query("R08_resume_batches", "SELECT doc_id, doc_id // 64 AS batch, CASE WHEN doc_id // 64 < 2 THEN 1 ELSE 2 END AS run FROM documents")
def r08(spark, sf):
    """Two batches in a first run, whose index is saved; a second run takes what the index says is left."""
    from braidwork.sources import files

    batches = _docs(spark, sf).select("doc_id", F.floor(F.col("doc_id") / 64).alias("batch"))
    index = files.new_path(spark, "sampling-index")
    first = buffer.remaining_batches(batches, "batch", index).filter("batch < 2").withColumn("run", F.lit(1))
    buffer.save_batches(first, "batch", index)
    return first.unionByName(buffer.remaining_batches(batches, "batch", index).withColumn("run", F.lit(2)))


@query("R09_resample", "SELECT doc_id FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 400) WHERE lang <> 'en' ORDER BY doc_id LIMIT 50")
def r09(spark, sf):
    return buffer.resample(_docs(spark, sf).withColumn("ok", F.col("lang") != "en"), "ok", "doc_id", 50, 400).select("doc_id")


@query("R10_take_skip", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def r10(spark, sf):
    return _docs(spark, sf).select("doc_id").orderBy("doc_id").offset(50).limit(100)


@query("E01_row_function", "SELECT event_id, i AS copy FROM events, range(0, 3) AS r(i) WHERE i < event_id % 3")
def e01(spark, sf):
    from braidwork.functions import extend

    def preprocess(row):
        n = row["event_id"] % 3
        return None if n == 0 else [{"event_id": row["event_id"], "copy": i} for i in range(n)]

    return extend.map_rows(table(spark, sf, "events").select("event_id"), preprocess, "event_id long, copy long")


@query("E01_table_function", "SELECT event_id, i AS copy, user_id FROM events, range(0, 3) AS r(i) WHERE i < event_id % 3")
def e01_table(spark, sf):
    """The row function from SQL, by LATERAL over the columns of a table."""
    from braidwork.functions import extend

    def preprocess(row):
        n = row["event_id"] % 3
        return None if n == 0 else [{"copy": i} for i in range(n)]

    spark.udtf.register("copies_of", extend.table_function(preprocess, "copy long", ["event_id"]))
    return spark.sql("SELECT e.event_id, c.copy, e.user_id FROM {events} e, LATERAL copies_of(e.event_id) c", events=table(spark, sf, "events"))


@query("E03_batched_reward", "SELECT event_id, round(value * 2 + user_id, 4) AS reward FROM events")
def e03(spark, sf):
    from braidwork.functions import extend

    reward = extend.batched_reward(lambda value, user_id: [v * 2 + u for v, u in zip(value, user_id)])
    return table(spark, sf, "events").select("event_id", F.round(reward("value", "user_id"), 4).alias("reward"))


@query("E06_metric_state", "SELECT event_type, round(sum(value) / count(*), 4) AS mean FROM events GROUP BY 1")
def e06(spark, sf):
    from braidwork.functions import extend

    class Mean:
        def __init__(self):
            self.total, self.n = 0.0, 0

        def update(self, values):
            self.total, self.n = self.total + sum(values), self.n + len(values)

        def merge(self, other):
            self.total, self.n = self.total + other.total, self.n + other.n

        def compute(self):
            return self.total / self.n

    out = extend.metric(table(spark, sf, "events"), "event_type", "value", Mean)
    return out.select(F.col("key").alias("event_type"), F.round("value", 4).alias("mean"))


@query("E08_rubric_columns", "SELECT event_id, round(0.5 * CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END + 0.5 * CASE WHEN value >= 10 THEN value / 500 ELSE 0 END, 6) AS score, 2 AS seen, CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END AS high FROM events")
def e08(spark, sf):
    from braidwork.functions import rubrics

    high = rubrics.Rubric("high", lambda action, seen: (seen > 40).cast("double"))
    scaled = rubrics.Rubric("scaled", lambda action, seen: rubrics.gate(seen / 500, 0.02))
    both = rubrics.Rubric("both", children=[(high, 0.5), (scaled, 0.5)])
    calls = []
    both.before(lambda r, action, seen: calls.append(r.name)).after(lambda r, action, seen, score: calls.append(r.name))
    rows = both.scored(table(spark, sf, "events"), F.col("event_type"), F.col("value"))
    return rows.select("event_id", F.round("both", 6).alias("score"), F.lit(len(calls)).alias("seen"), F.col("both/high").alias("high"))


@query("E09_parser_registry", "SELECT event_id, event_type AS name, CAST(user_id AS VARCHAR) AS id FROM events")
def e09(spark, sf):
    from braidwork.functions import tools

    t = F.concat(F.lit("<tool_call><function="), "event_type", F.lit("><parameter=id>"), F.col("user_id").cast("string"), F.lit("</parameter></function></tool_call>"))
    calls = table(spark, sf, "events").select("event_id", F.explode(tools.parsed("qwen3_coder", t)["calls"]).alias("c"))
    return calls.select("event_id", "c.name", F.get_json_object("c.arguments", "$.id").alias("id"))


@query("E11_keep_callback", "SELECT event_id FROM events WHERE value > 25 AND user_id % 2 = 0")
def e11(spark, sf):
    from braidwork.functions import extend

    kept, _ = extend.keep_episodes(table(spark, sf, "events"), lambda e: (e["value"] > 25) & (e["user_id"] % 2 == 0))
    return kept.select("event_id")


@query("W16_running_window", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations")
def running(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("seen"))
