"""Queries of filters, joins, set operations, sampling, retrieval and calendar operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.operators import filters, relational, retrieval, sampling

from .registry import query, table

_H = "md5('42|' || CAST({} AS VARCHAR))"
_DOC_H = _H.format("doc_id")


# ---- filters

@query("F01_drop_on_error", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 <> 0")
def f01(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return filters.drop_on_error(table(spark, sf, "events"), {"k": F.when(k % 7 != 0, k)}).select("event_id", "k")


@query("F02_reject_equal_response", "SELECT conv_id, any_value(c) AS last FROM (SELECT conv_id, max_by(text, turn) AS c, max_by(role, turn) AS r FROM conversations GROUP BY 1) WHERE r = 'assistant' AND length(c) % 5 <> 0 GROUP BY conv_id")
def f02(spark, sf):
    last = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.max_by("role", "turn").alias("r"))
    rejected = F.when(F.col("r") != "assistant", F.lit(None)).when(F.char_length("last") % 5 == 0, F.col("last")).otherwise(F.concat("last", F.lit("!")))
    return filters.rejected_differs(last.withColumn("rejected", rejected), "last", "rejected").select("conv_id", "last")


@query("F03_overlong_prompts", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2048")
def f03(spark, sf):
    return table(spark, sf, "documents").filter(F.coalesce("n_chars", F.lit(2049)) <= 2048).select("doc_id", "n_chars")


@query("F04_markers", "SELECT doc_id FROM documents WHERE starts_with(text, 'Th') AND contains(text, 'the and')")
def f04(spark, sf):
    return table(spark, sf, "documents").filter(F.startswith("text", F.lit("Th")) & F.contains("text", F.lit("the and"))).select("doc_id")


@query("F05_hard_success_fanout", "SELECT o_orderkey, g AS copy FROM orders, range(0, 4) AS r(g) WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND o_orderpriority <> '5-LOW'")
def f05(spark, sf):
    hard = (F.col("o_totalprice") > 200000) & (F.col("o_orderpriority") != "5-LOW")
    return filters.hard_successes(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", hard, 4).select("o_orderkey", "copy")


@query("F06_label_present", "SELECT DISTINCT p_partkey FROM part WHERE length(p_type) > 0")
def f06(spark, sf):
    return table(spark, sf, "part").filter(F.length("p_type") > 0).select("p_partkey").distinct()


@query("F07_reject_reasons", """
SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 10000 THEN 'long' WHEN lang <> 'en' THEN 'language' WHEN contains(text, '###') THEN 'markup' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def f07(spark, sf):
    n = F.col("n_chars")
    rules = [("short", n < 200), ("long", n > 10000), ("language", F.col("lang") != "en"), ("markup", F.contains("text", F.lit("###")))]
    return filters.reject_reasons(table(spark, sf, "documents"), rules)


@query("F08_dead_end_calls", r"""
WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error')
SELECT event_id, coalesce(regexp_matches(lower(props), 'error|: [45]\d'), false) AS dead_end FROM c LEFT JOIN r USING (user_id, k)""")
def f08(spark, sf):
    events = table(spark, sf, "events")
    calls = events.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    return filters.dead_ends(calls, events.filter("event_type = 'error'"), ["user_id"], ["ts", "event_id"], "props").select("event_id", "dead_end")


@query("F09_action_filter", "SELECT event_id FROM events WHERE event_type NOT IN ('signup', 'error') AND value > 1")
def f09(spark, sf):
    return table(spark, sf, "events").filter(~F.col("event_type").isin("signup", "error") & (F.col("value") > 1)).select("event_id")


@query("F10_missing_fields", """
SELECT 'k' AS path, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS missing FROM events UNION ALL SELECT 'absent', count(*) FILTER (json_extract_string(props, '$.absent') IS NULL) FROM events UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM events""")
def f10(spark, sf):
    paths = {"k": F.get_json_object("props", "$.k"), "absent": F.get_json_object("props", "$.absent"), "value": F.col("value")}
    return filters.missing_by_path(table(spark, sf, "events"), paths)


@query("F11_task_selection", """
SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) WHERE place BETWEEN 2 AND 90 OR place = 100 ORDER BY 1 LIMIT 80""")
def f11(spark, sf):
    return filters.select_tasks(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "c_custkey", places="2-90,100", most=80)


@query("F11_task_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (5, 7, 33, 100, 400)")
def f11_ids(spark, sf):
    wanted = [5, 7, 33, 100, 400, -1]  # the last is in no table and is ignored
    return filters.select_tasks(table(spark, sf, "orders"), "o_orderkey", "o_orderkey", ids=wanted, unknown="ignore").select("o_orderkey", "o_totalprice")


@query("F12_warmup_exclusion", "SELECT event_id FROM events WHERE user_id > 1 AND user_id <= 100 AND event_type <> 'signup'")
def f12(spark, sf):
    return table(spark, sf, "events").filter("user_id > 1 and user_id <= 100 and event_type <> 'signup'").select("event_id")


@query("F13_corrupt_exclusion", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, CASE WHEN n_chars < 100 THEN 1 ELSE 0 END) = 0")
def f13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return filters.corrupt_excluded(docs, table(spark, sf, "labels"), "doc_id", "toxic", F.col("n_chars") < 100).select("doc_id")


@query("F15_keep_predicate", "SELECT count(*) FILTER (value > 25) AS kept, count(*) FILTER (NOT value > 25) AS dropped FROM events")
def f15(spark, sf):
    return filters.kept_and_dropped(table(spark, sf, "events"), F.col("value") > 25)


@query("F16_score_mask", "SELECT event_id, value > 30 AS keep FROM events")
def f16(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("value") > 30).alias("keep"))


@query("F17_row_validity", "SELECT count(*) FILTER (length(trim(url)) > 0 AND length(trim(html)) > 0) AS kept, count(*) FILTER (NOT (length(trim(url)) > 0 AND length(trim(html)) > 0)) AS skipped FROM pages")
def f17(spark, sf):
    return filters.kept_and_dropped(table(spark, sf, "pages"), filters.has_text("url", "html"), "kept", "skipped")


@query("F18_exact_subset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer)")
def f18(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_orderkey"))
    return filters.exact_subset(table(spark, sf, "orders"), wanted, "o_orderkey").select("o_orderkey", "o_totalprice")


# ---- joins

@query("J01_judge_pairs", """
WITH b AS (SELECT user_id, event_type, max_by(value, event_id) AS v FROM events GROUP BY ALL)
SELECT e.event_id, e.value AS a, b.v AS b FROM events e JOIN b USING (user_id, event_type)""")
def j01(spark, sf):
    e = table(spark, sf, "events")
    right = relational.last_wins(e.select("user_id", "event_type", "event_id", F.col("value").alias("b")), ["user_id", "event_type"], ["event_id"]).drop("event_id")
    return e.join(right, ["user_id", "event_type"]).select("event_id", F.col("value").alias("a"), "b")


@query("J02_semi_joins", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j02(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").join(li, "o_orderkey", "left_semi").select("o_orderkey")


@query("J03_left_map", "SELECT doc_id, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j03(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("J04_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j04(spark, sf):
    taken = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(taken, "c_custkey", "left_anti").select("c_custkey")


@query("J05_last_advice", """
SELECT c_custkey, a.p AS advice FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) a ON o_custkey = c_custkey""")
def j05(spark, sf):
    advice = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), advice.alias("v"), "o_orderkey")
    return relational.attach_last(table(spark, sf, "customer").select("c_custkey"), right, ["c_custkey"], "v", "o_orderkey", "advice")


@query("J06_dimension_attach", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j06(spark, sf):
    # the planner broadcasts a dimension by its size, and shuffles one that has grown
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("J07_predictions_gold", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity * 1000 > o_totalprice / 10) AS hits FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def j07(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return table(spark, sf, "lineitem").join(o, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") * 1000 > F.col("o_totalprice") / 10).alias("hits"))


@query("J08_retry_plan", """
SELECT o_orderkey, s AS sample FROM orders, range(1, 8) AS r(s) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = s AND l_returnflag <> 'R')""")
def j08(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).alias("sample"), F.when(F.col("l_returnflag") == "R", "error").alias("error"))
    out = relational.retry_plan(table(spark, sf, "orders").select("o_orderkey"), 7, done, "o_orderkey")
    return out.select("o_orderkey", (F.col("sample") + 1).cast("long").alias("sample"))


@query("J09_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j09(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("J10_scores_default", "SELECT p_partkey, round(coalesce(s.v, 0), 4) AS score FROM part LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON l_partkey = p_partkey")
def j10(spark, sf):
    s = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("v"))
    return table(spark, sf, "part").select("p_partkey").join(s, "p_partkey", "left").select("p_partkey", F.round(F.coalesce("v", F.lit(0.0)), 4).alias("score"))


@query("J13_checked_union", "SELECT c_custkey AS key FROM customer UNION ALL SELECT s_suppkey + 10000000 FROM supplier")
def j13(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return relational.checked_union(a, table(spark, sf, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("key")), "key")


@query("J15_range_bins", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_quantity < 10 THEN 'a' WHEN l_quantity < 20 THEN 'b' WHEN l_quantity < 40 THEN 'c' ELSE 'd' END AS bin FROM lineitem")
def j15(spark, sf):
    bins = spark.createDataFrame([("a", 0.0, 10.0), ("b", 10.0, 20.0), ("c", 20.0, 40.0), ("d", 40.0, 1e9)], "bin string, lo double, hi double")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    # four bins in code, so broadcasting them is bounded
    return rows.join(F.broadcast(bins), (F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") < F.col("hi"))).select("l_orderkey", "l_partkey", "l_suppkey", "bin")


# ---- sets

_TRIPLES = """(SELECT 'n' || n_nationkey AS s, 'in' AS p, 'r' || n_regionkey AS o FROM nation UNION ALL SELECT 's' || s_suppkey, 'from', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'from', 'n' || c_nationkey FROM customer)"""


def triples(spark, sf):
    def one(t, a, s, p, b, o):
        return table(spark, sf, t).select(F.concat(F.lit(a), s).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(b), o).alias("o"))

    return one("nation", "n", "n_nationkey", "in", "r", "n_regionkey").union(one("supplier", "s", "s_suppkey", "from", "n", "s_nationkey")).union(one("customer", "c", "c_custkey", "from", "n", "c_nationkey"))


@query("J14_kg_join", f"WITH t AS {_TRIPLES} SELECT DISTINCT a.s FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'from' AND b.p = 'in' AND b.o = 'r1'")
def j14(spark, sf):
    t = triples(spark, sf)
    x = t.filter("p = 'in' and o = 'r1'").select(F.col("s").alias("o"))
    return t.filter("p = 'from'").join(x, "o", "left_semi").select("s").distinct()


@query("U01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u01(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionAll(table(spark, sf, "supplier").select("s_nationkey"))


@query("U02_kg_union_intersection", f"""WITH t AS {_TRIPLES} SELECT 'union' AS op, s FROM (SELECT s FROM t WHERE o = 'n1' UNION SELECT s FROM t WHERE o = 'n2') UNION ALL
SELECT 'intersection', s FROM (SELECT o AS s FROM t WHERE starts_with(t.s, 's') INTERSECT SELECT o FROM t WHERE starts_with(t.s, 'c'))""")
def u02(spark, sf):
    t = triples(spark, sf)
    union = t.filter("o = 'n1'").select("s").union(t.filter("o = 'n2'").select("s")).distinct()
    both = t.filter(F.startswith("s", F.lit("s"))).select(F.col("o").alias("s")).intersect(t.filter(F.startswith("s", F.lit("c"))).select("o"))
    return union.select(F.lit("union").alias("op"), "s").union(both.select(F.lit("intersection"), "s"))


@query("U03_kg_argmax", "SELECT c_nationkey, c_custkey, (SELECT count(DISTINCT c_custkey) FROM customer) AS n FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r = 1")
def u03(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    top = c.withColumn("r", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc()))).filter("r = 1")
    return top.crossJoin(F.broadcast(c.agg(F.count_distinct("c_custkey").alias("n")))).select("c_nationkey", "c_custkey", "n")


@query("U04_kg_relations", f"WITH t AS {_TRIPLES} SELECT DISTINCT p FROM t WHERE o IN ('n1', 'n2', 'r1') AND p IN ('from', 'in', 'unknown')")
def u04(spark, sf):
    return triples(spark, sf).filter(F.col("o").isin("n1", "n2", "r1") & F.col("p").isin("from", "in", "unknown")).select("p").distinct().orderBy("p")


@query("U05_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def u05(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("U06_dedupe_prompt", "SELECT DISTINCT text FROM documents")
def u06(spark, sf):
    return table(spark, sf, "documents").dropDuplicates(["text"]).select("text")


@query("U07_content_key", """SELECT n_nationkey, md5('{"name":"' || n_name || '","region":' || n_regionkey || '}') AS key FROM nation""")
def u07(spark, sf):
    body = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    return table(spark, sf, "nation").select("n_nationkey", F.md5(body).alias("key"))


@query("U08_set_f1", """
WITH s AS (SELECT l_orderkey, list(DISTINCT l_linenumber) FILTER (l_returnflag = 'A') AS a, list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT l_orderkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 OR len(list_intersect(a, b)) = 0 THEN 0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 4) AS f1, len(list_intersect(a, b)) = len(a) AND len(a) = len(b) AS exact FROM r""")
def u08(spark, sf):
    side = lambda f: F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_linenumber")))
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(side("A").alias("a"), side("R").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    f1 = F.when(both == 0, 0.0).otherwise(2.0 * both / F.greatest(F.size("a") + F.size("b"), F.lit(1)))
    return s.select("l_orderkey", F.round(f1, 4).alias("f1"), ((both == F.size("a")) & (F.size("a") == F.size("b"))).alias("exact"))


@query("U09_complement", "SELECT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 25")
def u09(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).subtract(table(spark, sf, "part").filter("p_size < 25").select("p_partkey"))


# ---- sampling, splits, order

@query("T01_sample_repeating", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_DOC_H}, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
SELECT doc_id, unnest(range(1, 1 + CAST(2500 // n + CASE WHEN place < 2500 % n THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM r""")
def t01(spark, sf):
    return sampling.sample_repeating(table(spark, sf, "documents").select("doc_id"), "doc_id", 2500).select("doc_id", F.col("copy").cast("long").alias("copy"))


@query("T02_split", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_DOC_H}, doc_id) AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN place <= greatest(floor(n * 0.1), 1) THEN 'val' ELSE 'train' END AS part FROM r""")
def t02(spark, sf):
    return sampling.split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1)


@query("T03_stream_split", "WITH t AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 600) SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 60 THEN 'val' ELSE 'train' END AS part FROM t")
def t03(spark, sf):
    head = table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(600)
    # 600 rows at most, so numbering them in one task is bounded
    return head.withColumn("part", F.when(F.row_number().over(Window.orderBy("doc_id")) <= 60, "val").otherwise("train"))


@query("T04_concatenate", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def t04(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))


_PICK = "CASE WHEN (CAST('0x' || substr(md5('42|' || slot), 1, 8) AS BIGINT) % 1000000) / 1000000.0 < 0.7 THEN 0 ELSE 1 END"


def _interleaved(until):
    return f"""
WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY {_H.format("o_orderkey")}, o_orderkey) - 1 AS k FROM orders),
b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY md5('43|' || c_custkey), c_custkey) - 1 AS k FROM customer),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
s AS (SELECT slot, {_PICK} AS source FROM range(0, 1000 + 3 * (SELECT na + nb FROM n)) AS r(slot)),
t AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM s),
e AS (SELECT {until}(slot) AS last FROM t, n WHERE k = CASE source WHEN 0 THEN na ELSE nb END - 1)
SELECT slot, source, coalesce(a.id, b.id) AS id FROM t, e, n LEFT JOIN a ON source = 0 AND a.k = t.k % na LEFT JOIN b ON source = 1 AND b.k = t.k % nb WHERE slot <= last"""


@query("T05_interleave_rare", """
WITH s AS (SELECT slot, CASE WHEN (CAST('0x' || substr(md5('42|' || slot), 1, 8) AS BIGINT) % 1000000) / 1000000.0 < 0.9997 THEN 0 ELSE 1 END AS source FROM range(0, 500000) AS r(slot)),
t AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM s),
a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY md5('42|' || s_suppkey), s_suppkey) - 1 AS k, count(*) OVER () AS n, 0 AS source FROM supplier
  UNION ALL SELECT r_regionkey, row_number() OVER (ORDER BY md5('43|' || r_regionkey), r_regionkey) - 1, count(*) OVER (), 1 FROM region),
e AS (SELECT max(slot) AS last FROM t JOIN (SELECT DISTINCT source, n FROM a) USING (source) WHERE k = n - 1)
SELECT t.source AS source, id, count(*) AS times, min(slot) AS first, (SELECT last FROM e) AS last FROM t JOIN a ON t.source = a.source AND t.k % a.n = a.k WHERE slot <= (SELECT last FROM e) GROUP BY ALL""")
def t05_rare(spark, sf):
    """Every row of a source that hardly any slot goes to."""
    parts = [(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), 0.9997), (table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id")), 0.0003)]
    rows = sampling.interleave(parts, "id", until="all")
    last = rows.agg(F.max("slot").alias("last"))
    return rows.groupBy("source", "id").agg(F.count("*").alias("times"), F.min("slot").alias("first")).crossJoin(F.broadcast(last))


def _interleave(spark, sf, until):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return sampling.interleave([(a, 0.7), (b, 0.3)], "id", until=until).select("slot", "source", "id")


@query("T05_interleave_first", _interleaved("min"))
def t05(spark, sf):
    return _interleave(spark, sf, "first")


@query("T05_interleave_all", _interleaved("max"))
def t05_all(spark, sf):
    return _interleave(spark, sf, "all")


@query("T06_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {_DOC_H}, doc_id) - 1 AS ordinal FROM documents")
def t06(spark, sf):
    return sampling.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "ordinal")


@query("T07_max_samples", f"SELECT doc_id FROM documents ORDER BY {_DOC_H}, doc_id LIMIT 300")
def t07(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy(sampling.hash_order("doc_id"), "doc_id").limit(300)


@query("T08_repeated_train", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_DOC_H}, doc_id) AS place FROM documents)
SELECT doc_id, CAST(NULL AS INT) AS copy, 'val' AS part FROM r WHERE place <= 50 UNION ALL SELECT doc_id, c, 'train' FROM r, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS c) WHERE place > 50""")
def t08(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    val = docs.orderBy(sampling.hash_order("doc_id"), "doc_id").limit(50)
    train = docs.join(val, "doc_id", "left_anti").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"), F.lit("train").alias("part"))
    return train.unionByName(val.select("doc_id", F.lit(None).cast("int").alias("copy"), F.lit("val").alias("part")))


@query("T09_held_out", """
WITH f AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM f GROUP BY 1 ORDER BY 1 LIMIT 150""")
def t09(spark, sf):
    out = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sampling.held_out(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), out, ["o_orderkey"], "o_custkey", ["o_orderkey"], 150)


@query("T10_shards", """
WITH r AS (SELECT doc_id, doc_id % 4 AS rank, (doc_id // 4) // 32 AS batch FROM documents) SELECT doc_id, rank, batch FROM (SELECT *, count(*) OVER (PARTITION BY rank, batch) AS c FROM r) WHERE c = 32""")
def t10(spark, sf):
    return sampling.shards(table(spark, sf, "documents").select("doc_id"), "doc_id", 4, 32).select("doc_id", "rank", "batch")


@query("T10_length_grouped", f"""
WITH h AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY {_DOC_H}, doc_id) - 1 AS place, greatest(least(count(*) OVER () // 32, 50), 1) * 8 AS size FROM documents),
m AS (SELECT doc_id, n_chars, place // size * size + row_number() OVER (PARTITION BY place // size ORDER BY n_chars DESC, place) - 1 AS n FROM h), f AS (SELECT max_by(n, (n_chars, -n)) AS longest FROM m)
SELECT doc_id, CAST(CASE n WHEN longest THEN 0 WHEN 0 THEN longest ELSE n END AS BIGINT) AS ordinal FROM m, f""")
def t10_lengths(spark, sf):
    return sampling.length_grouped(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 8).select("doc_id", "ordinal")


@query("T11_piece", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () // 7 AS piece FROM documents) WHERE o >= 2 * piece AND o < 3 * piece")
def t11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    rows = sampling.ordinals(docs, ["doc_id"], "o", F.floor(F.col("doc_id") / 65536))
    piece = docs.agg(F.floor(F.count("*") / 7).alias("piece"))
    return rows.crossJoin(F.broadcast(piece)).filter("o >= 2 * piece and o < 3 * piece").select("doc_id")


@query("T12_cosine_top_k", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 12) AS sim FROM q, v WHERE q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= 0.1)
SELECT query_id, id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def t12(spark, sf):
    vectors = table(spark, sf, "embeddings")
    out = retrieval.cosine_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 10, 0.1)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("T12_index_recall")
def t12_recall(spark, sf):
    """Of each query's ten nearest rows, how many the lists of a quarter of the cells hold."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id % 50 = 0")
    index = retrieval.vector_index(vectors)
    found = retrieval.index_top_k(index, asked, 10, 0.1, probes=-(-len(index.centres) // 4), exact=False)
    return retrieval.recall(found, retrieval.index_top_k(index, asked, 10, 0.1))


@query("T13_tiered_retrieval", """
WITH v AS (SELECT vec_id, CAST(label % 4 AS VARCHAR) AS tier, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.tier, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 12) AS sim FROM q, v WHERE q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= 0.05)
SELECT query_id, tier, id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 3""")
def t13(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn("tier", (F.col("label") % 4).cast("string"))
    out = retrieval.cosine_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 3, 0.05, tier="tier")
    return out.select("query_id", "tier", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("T14_keyword_top_k", r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM documents),
c AS (SELECT doc_id, n, w, count(*) AS c FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM benchmark),
s AS (SELECT item_id AS question, doc_id, sum(c / n) AS score FROM c JOIN q USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 10) DESC, doc_id) AS rank FROM s)
SELECT question, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def t14(spark, sf):
    out = retrieval.keyword_top_k(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 5)
    return out.select("question", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("T15_pinned_union", "SELECT conv_id, turn FROM conversations WHERE turn = 0 UNION SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r <= 2")
def t15(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("n").desc(), "turn"))).filter("r <= 2")
    return c.filter("turn = 0").select("conv_id", "turn").union(top.select("conv_id", "turn")).dropDuplicates()


@query("T16_oldest_keys", "SELECT event_id, user_id FROM events WHERE event_type = 'view' ORDER BY user_id, event_id LIMIT 64")
def t16(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'view'").select("event_id", "user_id").orderBy("user_id", "event_id").limit(64)


@query("T17_round_robin", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn, min(event_id) OVER (PARTITION BY event_type) AS prefix_order FROM events")
def t17(spark, sf):
    return sampling.round_robin(table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["event_id"]).select("event_id", "turn", "prefix_order")


# ---- calendar

_P = "(SELECT event_id, user_id, event_type, ts AS s, ts + to_microseconds(CAST(round(value * 60) AS BIGINT) * 1000000) AS e FROM events)"
_LOW, _HIGH = "2024-01-10 00:00:00", "2024-01-12 00:00:00"


def periods(spark, sf):
    """Events as periods of `value` minutes, to the second."""
    rows = table(spark, sf, "events").withColumn("s", F.col("ts").cast("timestamp"))
    end = F.timestamp_micros(F.unix_micros("s") + F.round(F.col("value") * 60).cast("long") * 1_000_000)
    return rows.select("event_id", "user_id", "event_type", "s", end.alias("e"))


@query("C01_overlap_filter", f"SELECT event_id FROM {_P} WHERE s < TIMESTAMP '{_HIGH}' AND e > TIMESTAMP '{_LOW}' AND event_type <> 'error'")
def c01(spark, sf):
    rows = periods(spark, sf).filter("event_type <> 'error'")
    return relational.overlapping(rows, "s", "e", F.to_timestamp(F.lit(_LOW)), F.to_timestamp(F.lit(_HIGH))).select("event_id")


@query("C01_overlap_join", f"SELECT a.event_id, b.event_id AS b_event_id FROM {_P} a JOIN {_P} b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e")
def c01_join(spark, sf):
    rows = periods(spark, sf)
    out = relational.overlap_join(rows.filter("event_type = 'view'"), rows.filter("event_type = 'click'"), "s", "e", 3600, ("user_id",))
    return out.select("event_id", "b_event_id")


@query("C02_clip", f"SELECT event_id, greatest(s, TIMESTAMP '{_LOW}') AS s, least(e, TIMESTAMP '{_HIGH}') AS e FROM {_P} WHERE s < TIMESTAMP '{_HIGH}' AND e > TIMESTAMP '{_LOW}'")
def c02(spark, sf):
    return relational.clipped(periods(spark, sf), "s", "e", F.to_timestamp(F.lit(_LOW)), F.to_timestamp(F.lit(_HIGH))).select("event_id", "s", "e")


@query("C03_merge_periods", f"""
WITH m AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {_P}),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM m)
SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, k""")
def c03(spark, sf):
    return relational.merged_periods(periods(spark, sf), "user_id", "s", "e")


@query("C04_page", "SELECT o_orderkey, o_totalprice, true AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def c04(spark, sf):
    return relational.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 100, 50)


@query("C05_incremental_sync", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def c05(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("deleted", F.col("event_type") == "error")
    return relational.changed_since(rows, "ts", "deleted", F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("event_id")


@query("C05_full_sync", "SELECT event_id FROM events WHERE event_type <> 'error'")
def c05_full(spark, sf):
    rows = table(spark, sf, "events").withColumn("deleted", F.col("event_type") == "error")
    return relational.changed_since(rows, "ts", "deleted").select("event_id")


@query("C06_role_threshold", """
WITH p AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'freeBusyReader' WHEN 1 THEN 'reader' WHEN 2 THEN 'writer' ELSE 'owner' END AS role, c_nationkey % 4 AS r FROM customer ORDER BY c_custkey LIMIT 100)
SELECT c_custkey, role FROM p WHERE r >= 2""")
def c06(spark, sf):
    m = F.col("c_nationkey") % 4
    role = F.when(m == 0, "freeBusyReader").when(m == 1, "reader").when(m == 2, "writer").otherwise("owner")
    # the page is cut first, so it may end up short: that is the operator
    page = table(spark, sf, "customer").orderBy("c_custkey").limit(100).select("c_custkey", role.alias("role"))
    return page.filter(relational.role_rank(F.col("role")) >= 2)


@query("C07_acl_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'MACHINERY' AND r_regionkey <> 0")
def c07(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_regionkey <> 0"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("C08_count_max", "SELECT count(*) AS n, coalesce(max(ts), TIMESTAMP '1970-01-01') AS latest FROM events WHERE event_type = 'view'")
def c08(spark, sf):
    rows = table(spark, sf, "events").filter("event_type = 'view'")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("ts").cast("timestamp")), F.to_timestamp(F.lit("1970-01-01"))).alias("latest"))


@query("C09_ordered_scan", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 100 OFFSET 20")
def c09(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.col("event_id").desc()).offset(20).limit(100)


@query("C10_dense_index", "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(split_part(c_name, '#', 2) AS BIGINT)) - 1 AS task_idx FROM customer")
def c10(spark, sf):
    suffix = F.split_part("c_name", F.lit("#"), F.lit(2)).cast("long")
    idx = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(suffix)) - 1
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", idx.alias("task_idx"))
