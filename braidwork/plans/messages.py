"""Queries of schema normalising and conversation transforms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.functions import text as tx
from braidwork.operators import messages as ms

from .registry import query, table


def conversations(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: ms.message(t["role"], t["content"])).alias("messages"))


def turns(df, messages):
    """One row a message."""
    return df.select("conv_id", F.posexplode(messages).alias("i", "m")).select("conv_id", "i", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


_T = "(SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS i, role, text AS content FROM conversations)"


@query("P01_safe_rename", "SELECT n_nationkey AS id, n_name, n_regionkey FROM nation")
def p01(spark, sf):
    df = table(spark, sf, "nation")
    return ms.safe_rename(df, {"N_NATIONKEY": "id", "n_name": "x", "N_REGIONKEY": "x", "absent": "y"})


@query("P02_standard_keys", "SELECT 'a' AS messages, doc_id AS label FROM documents")
def p02(spark, sf):
    return ms.keep_standard(table(spark, sf, "documents").select(F.lit("a").alias("messages"), F.col("doc_id").alias("label"), "lang", "source"))


@query("P03_alias_tables", "SELECT item_id AS id, text AS query, item_id % 3 AS system FROM benchmark")
def p03(spark, sf):
    return ms.alias_columns(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("Question"), (F.col("item_id") % 3).alias("system_prompt")))


@query("P04_preprocessor_choice", """
SELECT 'messages' AS kind, 'conversations' AS name, count(DISTINCT conv_id) AS rows, CAST(count(*) AS BIGINT) AS messages FROM conversations
UNION ALL SELECT 'alpaca', 'instruct', count(*), CAST(2 * count(*) AS BIGINT) FROM part UNION ALL SELECT 'response', 'plain', count(*), CAST(2 * count(*) AS BIGINT) FROM part""")
def p04(spark, sf):
    tables = {
        "conversations": conversations(spark, sf),
        "instruct": table(spark, sf, "part").select(F.col("p_name").alias("instruction"), F.col("p_type").alias("input"), F.col("p_brand").alias("output")),
        "plain": table(spark, sf, "part").select(F.col("p_name").alias("query"), F.col("p_brand").alias("response")),
    }
    rows = [ms.prepared(df).select(F.size("messages").alias("size")).agg(F.count("*").alias("rows"), F.sum("size").alias("messages")) for df in tables.values()]
    kinds = [r.select(F.lit(ms.preprocessor_kind(df)).alias("kind"), F.lit(n).alias("name"), "rows", "messages") for r, (n, df) in zip(rows, tables.items())]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("P05_history_to_messages", "SELECT c_custkey AS conv_id, unnest([0, 1, 2, 3]) AS i, unnest(['user', 'assistant', 'user', 'assistant']) AS role, unnest(['q', 'a', c_name, c_mktsegment]) AS content FROM customer")
def p05(spark, sf):
    rows = table(spark, sf, "customer").withColumnRenamed("c_custkey", "conv_id")
    history = F.array(F.array(F.lit("q"), F.lit("a")))
    return turns(rows, ms.from_pairs(F.col("c_name"), F.col("c_mktsegment"), F.lit(None).cast("string"), history))


@query("P05_list_responses", """
SELECT o_custkey AS conv_id, unnest([0, 1]) AS i, unnest(['user', 'assistant']) AS role, unnest(['c' || o_custkey, list(o_orderpriority ORDER BY o_orderkey)[1]]) AS content FROM orders GROUP BY o_custkey""")
def p05_lists(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("conv_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("answers"))
    return turns(rows, ms.from_pairs(F.concat(F.lit("c"), F.col("conv_id").cast("string")), ms.one_response(F.col("answers"))))


@query("P06_merge_instruction", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || chr(10) || p_type ELSE p_name END AS query FROM part")
def p06(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ms.merge_instruction(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")).alias("query"))


@query("P07_normalise_messages", f"""
WITH f AS (SELECT conv_id, bool_or(role = 'system' AND i = 0) AS has FROM {_T} GROUP BY 1)
SELECT conv_id, CAST(i + CASE WHEN has THEN 0 ELSE 1 END AS INT) AS i, role, content FROM {_T} JOIN f USING (conv_id) UNION ALL SELECT conv_id, 0, 'system', 'be brief' FROM f WHERE NOT has""")
def p07(spark, sf):
    odd = F.transform("messages", lambda m: ms.message(F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]), m["content"]))
    return turns(conversations(spark, sf), ms.normalised(odd, F.lit("be brief")))


@query("P08_pair_form", "SELECT c_custkey AS conv_id, unnest([0, 1]) AS i, unnest(['user', 'assistant']) AS role, unnest([c_name, c_mktsegment]) AS content FROM customer")
def p08(spark, sf):
    rows = table(spark, sf, "customer").withColumnRenamed("c_custkey", "conv_id")
    return turns(rows, ms.pair_form(F.array(F.struct(F.col("c_name").alias("user"), F.col("c_mktsegment").alias("assistant")))))


@query("P09_literal_repair", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE '{"k": ' || CAST(user_id AS VARCHAR) || '}' END AS parsed FROM events""")
def p09(spark, sf):
    u = F.col("user_id").cast("string")
    m = F.col("event_id") % 3
    t = F.when(m == 0, F.concat(F.lit("{'k': "), u, F.lit("}"))).when(m == 1, F.concat(F.lit('{"k":'), u, F.lit("}"))).otherwise(F.lit("{oops"))
    return table(spark, sf, "events").select("event_id", tx.python_literal_udf(t).alias("parsed"))


@query("P10_valid_messages", "SELECT conv_id FROM conversations GROUP BY 1 HAVING bool_and(role IN ('system', 'user', 'assistant') AND text IS NOT NULL)")
def p10(spark, sf):
    return conversations(spark, sf).filter(ms.valid(F.col("messages"))).select("conv_id")


@query("P11_label_cast", "SELECT doc_id, toxic AS label FROM labels")
def p11(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").cast("int").alias("label"))


@query("P12_prompt_template", "SELECT p_partkey, 'Describe: ' || p_name || '!' AS query FROM part")
def p12(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.replace(F.lit("Describe: {{QUERY}}!"), F.lit("{{QUERY}}"), F.col("p_name")).alias("query"))


@query("P13_label_text", "SELECT doc_id, CASE quality WHEN 0 THEN 'poor' ELSE 'good' END AS label FROM labels WHERE quality IS NOT NULL")
def p13(spark, sf):
    return ms.label_text(table(spark, sf, "labels"), "quality", ["poor", "good"], "label").select("doc_id", "label")


@query("P14_media_cast", "SELECT page_id, url AS path FROM pages")
def p14(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(ms.media(F.array("url"))).alias("m")).select("page_id", F.col("m.path").alias("path"))


@query("P15_ordered_boxes", "SELECT l_orderkey, l_partkey, l_suppkey, least(l_quantity, l_tax * 100) AS x0, greatest(l_quantity, l_tax * 100) AS x1, least(l_discount, l_tax) AS y0, greatest(l_discount, l_tax) AS y1 FROM lineitem")
def p15(spark, sf):
    box = F.array("l_quantity", "l_discount", F.col("l_tax") * 100, "l_tax")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", ms.ordered_boxes(F.array(box))[0].alias("b"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", F.col("b")[0].alias("x0"), F.col("b")[2].alias("x1"), F.col("b")[1].alias("y0"), F.col("b")[3].alias("y1"))


@query("P16_routing_tag", "SELECT doc_id, 'documents' AS dataset FROM documents")
def p16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lit("documents").alias("dataset"))


@query("P17_unshadow", "SELECT n_nationkey AS id, n_name AS label FROM nation")
def p17(spark, sf):
    df = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("__@label"), F.lit(0).alias("__@id"))
    return ms.unshadow(df, "__@")


@query("P18_prompt_rows", "SELECT 'bench' AS data_source, text AS prompt, 'math' AS ability, CAST(length(text) AS VARCHAR) AS ground_truth, row_number() OVER (ORDER BY item_id) - 1 AS index FROM benchmark")
def p18(spark, sf):
    # the index is the stored ordinal of the table; the benchmark's ids are dense
    out = table(spark, sf, "benchmark").select(
        F.lit("bench").alias("data_source"), F.array(ms.message("user", F.col("text"))).alias("prompt"), F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.char_length("text").cast("string").alias("ground_truth")).alias("reward_model"), F.struct(F.col("item_id").alias("index")).alias("extra_info"),
    )
    return out.select("data_source", F.col("prompt")[0]["content"].alias("prompt"), "ability", F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.index").alias("index"))


@query("P19_preference_rows", "SELECT p_partkey, unnest(['chosen', 'rejected']) AS kind, unnest([p_name, p_type]) AS response FROM part")
def p19(spark, sf):
    both = F.array(F.struct(F.lit("chosen").alias("kind"), F.col("p_name").alias("response")), F.struct(F.lit("rejected").alias("kind"), F.col("p_type").alias("response")))
    return table(spark, sf, "part").select("p_partkey", F.explode(both).alias("x")).select("p_partkey", "x.kind", "x.response")


@query("P20_search_rows", """
SELECT p_partkey AS index, 'searchR1_' || p_brand AS data_source, 'Ask: ' || p_name AS question, CASE WHEN p_size > 25 THEN [p_brand] ELSE [p_type, p_name] END AS ground_truth, 'train' AS split FROM part""")
def p20(spark, sf):
    truth = F.when(F.col("p_size") > 25, F.array("p_brand"))
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("data_source"), F.lit("qa").alias("ability"), truth.alias("ground_truth"), F.array("p_type", "p_name").alias("golden_answers"))
    out = ms.search_rows(rows, "train", "p_partkey", "Search first.", "Ask: \n")
    return out.select("extra_info.index", "data_source", F.col("prompt")[1]["content"].alias("question"), "ground_truth", "extra_info.split")


@query("P21_choice_cleanup", "SELECT p_partkey, p_name || '. ' || p_type AS text FROM part")
def p21(spark, sf):
    raw = F.concat("p_name", F.lit(" [title] "), "p_type", F.lit("[substeps]"))
    return table(spark, sf, "part").select("p_partkey", ms.choice_cleanup(raw).alias("text"))


@query("P22_flat_tool_turns", """SELECT c_custkey AS conv_id, unnest([0, 1, 2, 3]) AS i, unnest(['user', 'assistant', 'tool_call', 'tool_response']) AS role,
  unnest([c_name, '<think>hm</think>ok', '{"name": "f", "arguments": {"x": ' || c_nationkey || '}}', c_mktsegment]) AS content FROM customer""")
def p22(spark, sf):
    call = "array<struct<name:string,arguments:string>>"

    def turn(role, content, reasoning=None, calls=None):
        none = F.lit(None)
        return F.struct(F.lit(role).alias("role"), content.alias("content"), (reasoning if reasoning is not None else none).cast("string").alias("reasoning"), (calls if calls is not None else none).cast(call).alias("tool_calls"))

    args = F.concat(F.lit('{"x": '), F.col("c_nationkey").cast("string"), F.lit("}"))
    raw = F.array(
        turn("user", F.col("c_name")),
        turn("assistant", F.lit(" ok "), F.lit("hm"), F.array(F.struct(F.lit("f").alias("name"), args.alias("arguments")))),
        turn("tool", F.col("c_mktsegment")),
    )
    return turns(table(spark, sf, "customer").withColumnRenamed("c_custkey", "conv_id"), ms.flat_tools(raw))


@query("P23_merged_tool_turns", r"""SELECT c_custkey AS conv_id, unnest([0, 1, 2]) AS i, unnest(['user', 'assistant', 'tool']) AS role,
  unnest([c_name, 'go' || chr(10) || chr(10) || '<tool_call>' || chr(10) || 'a' || chr(10) || '</tool_call>' || chr(10) || '<tool_call>' || chr(10) || 'b' || chr(10) || '</tool_call>', c_mktsegment]) AS content FROM customer""")
def p23(spark, sf):
    raw = F.array(ms.message("user", F.col("c_name")), ms.message("assistant", F.lit("go")), ms.message("tool_call", F.lit("a")), ms.message("tool_call", F.lit("b")), ms.message("tool_response", F.col("c_mktsegment")))
    return turns(table(spark, sf, "customer").withColumnRenamed("c_custkey", "conv_id"), ms.merged_tools(raw))


@query("P24_task_prefix", "SELECT conv_id, min_by(text, turn) FILTER (role = 'system') AS system, min_by(text, turn) FILTER (role = 'user') AS first_user FROM conversations GROUP BY 1")
def p24(spark, sf):
    pick = lambda r: F.get(F.filter("messages", lambda m: m["role"] == r), F.lit(0))["content"]
    return conversations(spark, sf).select("conv_id", pick("system").alias("system"), pick("user").alias("first_user"))


@query("P25_cut_prefix", f"""
WITH c AS (SELECT conv_id, min(i) FILTER (role = 'user' AND contains(content, 'the')) AS cut, count(*) AS n FROM {_T} GROUP BY 1)
SELECT conv_id, i, role, content FROM {_T} JOIN c USING (conv_id) WHERE i < coalesce(cut, n) UNION ALL SELECT conv_id, CAST(coalesce(cut, n) AS INT), 'user', 'reset' FROM c""")
def p25(spark, sf):
    return turns(conversations(spark, sf), ms.cut_before(F.col("messages"), "the", "reset"))


@query("P26_message_range", f"WITH n AS (SELECT conv_id FROM {_T} GROUP BY 1 HAVING count(*) >= 3) SELECT conv_id, CAST(i - 1 AS INT) AS i, role, content FROM {_T} JOIN n USING (conv_id) WHERE i IN (1, 2)")
def p26(spark, sf):
    return turns(conversations(spark, sf), ms.between(F.col("messages"), F.lit(1), F.lit(3)))


@query("P27_teacher_view", f"""
WITH f AS (SELECT conv_id, bool_or(role = 'system' AND i = 0) AS has FROM {_T} GROUP BY 1)
SELECT conv_id, CAST(i + CASE WHEN has THEN 0 ELSE 1 END AS INT) AS i, role, CASE WHEN has AND i = 0 THEN content || chr(10) || chr(10) || 'advice' ELSE content END AS content FROM {_T} JOIN f USING (conv_id) UNION ALL SELECT conv_id, 0, 'system', 'advice' FROM f WHERE NOT has""")
def p27(spark, sf):
    return turns(conversations(spark, sf), ms.with_advice(F.col("messages"), F.lit("advice")))


@query("P28_placeholders", "SELECT p_partkey, unnest([0, 1, 2, 3]) AS i, unnest(['text', 'image', 'text', 'video']) AS kind, unnest([p_name, NULL, p_type, NULL]) AS value FROM part")
def p28(spark, sf):
    t = F.concat("p_name", F.lit("<image>"), "p_type", F.lit("<video>"))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(ms.placeholder_segments(t)).alias("i", "s")).select("p_partkey", "i", "s.kind", "s.value")


@query("P28_media_segments", """
SELECT p_partkey, unnest([0, 0, 0, 1, 1, 1]) AS m, unnest([0, 1, 2, 0, 1, 2]) AS i, unnest(['text', 'image', 'video', 'text', 'image', 'text']) AS kind, unnest([p_name, p_brand, p_brand, p_type, p_name, chr(1) || 'x']) AS value FROM part""")
def p28_media(spark, sf):
    raw = F.array(ms.message("user", F.concat("p_name", F.lit("<image><video>"))), ms.message("user", F.concat("p_type", F.lit("<image>\x01x"))))
    segments = ms.media_segments(raw, {"image": F.array("p_brand", "p_name"), "video": F.array("p_brand")})
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(segments).alias("m", "segs"))
    return rows.select("p_partkey", "m", F.posexplode("segs").alias("i", "s")).select("p_partkey", "m", "i", "s.kind", "s.value")


@query("P29_strip_metadata", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS index, 'none' AS tools FROM events")
def p29(spark, sf):
    rows = table(spark, sf, "events").withColumn("extra", F.from_json("props", "k long, tools string"))
    return ms.with_defaults(rows, "extra", {"k": F.lit(0), "tools": F.lit("none")}).select("event_id", F.col("k").alias("index"), "tools")


@query("P30_path_columns", "SELECT lang AS model, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def p30(spark, sf):
    from braidwork.sources import files

    root = files.new_path(spark, "runs")
    docs = table(spark, sf, "documents")
    # the folder of a language is its text in hex after an x, so that any name, an empty one and null (no x) are told apart
    folder = F.coalesce(F.concat(F.lit("x"), F.hex(F.col("lang").cast("binary"))), F.lit("null"))
    docs.select("doc_id", folder.alias("model"), F.lit("plain").alias("mode"), F.lit("qa").alias("task")).write.partitionBy("model", "mode", "task").parquet(root)
    rows = ms.path_columns(spark.read.schema("doc_id long").parquet(f"{root}/*/*/*"), ["name", "mode", "task"]).filter("mode = 'plain' and task = 'qa'")
    model = F.when(F.col("name") != "null", F.decode(F.unhex(F.substring("name", 2, 1 << 30)), "UTF-8"))
    return rows.groupBy(model.alias("model")).agg(F.count("*").alias("n"))


@query("P31_messages_to_history", f"""
WITH s AS (SELECT conv_id, bool_or(role = 'system' AND i = 0) AS has FROM {_T} GROUP BY 1),
r AS (SELECT conv_id, i - CASE WHEN has THEN 1 ELSE 0 END AS j, content FROM {_T} JOIN s USING (conv_id) WHERE NOT (has AND i = 0))
SELECT conv_id, CAST(j // 2 AS INT) AS i, max(content) FILTER (j % 2 = 0) AS query, max(content) FILTER (j % 2 = 1) AS response FROM r GROUP BY ALL""")
def p31(spark, sf):
    history, _ = ms.to_pairs(F.col("messages"))
    rows = conversations(spark, sf).select("conv_id", F.posexplode(history).alias("i", "h"))
    return rows.select("conv_id", "i", F.col("h")[0].alias("query"), F.col("h")[1].alias("response"))


@query("P32_split_parts", "SELECT event_id, unnest([0, 1, 2]) AS i, unnest(['', 'Action:', 'Result:']) AS key, unnest(['x ', event_type, CAST(user_id AS VARCHAR)]) AS content FROM events")
def p32(spark, sf):
    t = F.concat(F.lit("x Action:"), "event_type", F.lit("Result:"), F.col("user_id").cast("string"))
    rows = table(spark, sf, "events").select("event_id", F.posexplode(ms.split_parts(t, ["Action:", "Result:"])).alias("i", "p"))
    return rows.select("event_id", "i", "p.key", "p.content")


@query("P32_overlapping_parts", """
SELECT event_id, 'literal' AS mode, unnest([0, 1, 2]) AS i, unnest(['', 'aab', 'ab']) AS key, unnest([event_type || chr(1), 'x' || chr(2), '']) AS content FROM events
UNION ALL SELECT event_id, 'regex', unnest([0, 1, 2]), unnest(['', '<.*?>', '']), unnest([event_type, '<' || user_id || chr(10) || '>', 'z']) FROM events""")
def p32_overlap(spark, sf):
    literal = ms.split_parts(F.concat("event_type", F.lit("\x01aabx\x02ab")), ["aab", "ab"])
    regex = ms.split_parts(F.concat("event_type", F.lit("<"), F.col("user_id").cast("string"), F.lit("\n>z")), ["<.*?>"], regex=True)
    e = table(spark, sf, "events")
    parts = [e.select("event_id", F.lit(n).alias("mode"), F.posexplode(c).alias("i", "p")) for n, c in (("literal", literal), ("regex", regex))]
    return parts[0].unionByName(parts[1]).select("event_id", "mode", "i", "p.key", "p.content")


@query("P33_parse_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '_' || CAST(event_id AS VARCHAR) AS task_id FROM events")
def p33(spark, sf):
    rows = ms.parsed_columns(table(spark, sf, "events").withColumn("raw", F.col("props")), {"props": "k long"})
    return ms.with_task_ids(rows, F.get_json_object("raw", "$.task_id"), "event_type", "event_id").select("event_id", "props.k", "task_id")


@query("P34_truncation_flag", "SELECT event_id, user_id % 3 = 0 AS truncated, event_type AS route FROM events")
def p34(spark, sf):
    reason = F.when(F.col("user_id") % 3 == 0, "length").otherwise("stop")
    tags = F.create_map(F.lit("route"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", (reason == "length").alias("truncated"), tags["route"].alias("route"))


@query("J06_rounds_preceding", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def rounds(spark, sf):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", before.alias("before"))
