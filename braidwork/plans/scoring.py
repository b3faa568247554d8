"""Queries of scalar functions: normalising, matching, rewards, parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.functions import extend, payloads
from braidwork.functions import text as tx

from .registry import query, table

# Pairs of texts: a turn and the one after it.
_PAIRS = "(SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)"
_WORDS = "array_to_string(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
_N1 = _WORDS.format(r"translate(lower({}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')")
_N2 = _WORDS.format(r"regexp_replace(lower({}), '[^\pL\pM\pN_\s]', ' ', 'g')")


def pairs(spark, sf):
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("a"), nxt.alias("b"))


@query("X01_normalise_answer", f"SELECT item_id, {_N1.format('text')} AS n FROM benchmark")
def x01(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.normalise_answer(F.col("text")).alias("n"))


@query("X02_normalise_text", f"SELECT item_id, {_N2.format('text')} AS n FROM benchmark")
def x02(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.normalise_text(F.col("text")).alias("n"))


_ORD = "(SELECT o_orderkey, o_custkey, upper(o_orderpriority) AS p, list_value('1 urgent', o_orderpriority || '.', 'the low') AS g FROM orders)"


@query("X03_exact_match", "SELECT o_orderkey, 1 AS em, CASE WHEN o_orderpriority IN ('5-LOW') THEN 1 ELSE 0 END AS low, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS status FROM orders")
def x03(spark, sf):
    p = F.upper("o_orderpriority")
    golds = F.array(F.lit("1 urgent"), F.concat("o_orderpriority", F.lit(".")), F.lit("nothing"))
    return table(spark, sf, "orders").select("o_orderkey", tx.any_match(p, golds).alias("em"), tx.any_contained(p, F.array(F.lit("the Low!"))).alias("low"), tx.exact_match(F.col("o_orderstatus"), F.lit("the f.")).alias("status"))


@query("X04_token_f1", f"""
WITH p AS (SELECT conv_id, turn, list_filter(string_split({_N2.format('a')}, ' '), lambda w: w <> '') AS x, list_filter(string_split({_N2.format('b')}, ' '), lambda w: w <> '') AS y FROM {_PAIRS} WHERE b IS NOT NULL),
u AS (SELECT conv_id, turn, w, sum(i) AS i, sum(j) AS j FROM (SELECT conv_id, turn, unnest(x) AS w, 1 AS i, 0 AS j FROM p UNION ALL SELECT conv_id, turn, unnest(y), 0, 1 FROM p) GROUP BY ALL),
c AS (SELECT conv_id, turn, sum(least(i, j)) AS c FROM u GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN coalesce(c, 0) = 0 THEN 0 ELSE 2.0 * c / (len(x) + len(y)) END, 6) AS f1 FROM p LEFT JOIN c USING (conv_id, turn)""")
def x04(spark, sf):
    rows = pairs(spark, sf).filter("b is not null").select("conv_id", "turn", tx.words(tx.normalise_text(F.col("a"))).alias("x"), tx.words(tx.normalise_text(F.col("b"))).alias("y"))
    return rows.select("conv_id", "turn", F.round(tx.token_f1(F.col("x"), F.col("y")), 6).alias("f1"))


@query("X05_numeric_accuracy", "SELECT event_id, CASE WHEN user_id = CAST(json_extract_string(props, '$.k') AS BIGINT) THEN 1.0 ELSE 0.0 END AS score FROM events")
def x05(spark, sf):
    a = F.concat(F.lit("it is "), F.col("user_id").cast("string"), F.lit(" now"))
    return table(spark, sf, "events").select("event_id", tx.numeric_accuracy(a, F.col("props")).alias("score"))


@query("X06_choice_contains_overlap", "SELECT event_id, CASE WHEN user_id % 4 = event_id % 4 THEN 1.0 ELSE 0.0 END AS choice, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS contains, round(CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.5 ELSE 0 END, 4) AS overlap FROM events")
def x06(spark, sf):
    a = F.concat(F.lit("option "), (F.col("user_id") % 4).cast("string"))
    b = F.concat(F.lit("answer: "), (F.col("event_id") % 4).cast("string"))
    w = tx.words(tx.normalise_text(F.lit("view, click")))
    e = F.col("event_type")
    return table(spark, sf, "events").select("event_id", tx.choice_accuracy(a, b).alias("choice"), tx.contains_score(F.lit("the click!"), e).alias("contains"), F.round(tx.jaccard(tx.words(tx.normalise_text(e)), w), 4).alias("overlap"))


@query("X07_hash_answer", r"""
WITH s AS (SELECT event_id, 'so ' || CAST(value AS VARCHAR) || ' then ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '#### 1,' || CAST(user_id AS VARCHAR) || ' ' END || 'end.' AS t FROM events)
SELECT event_id, replace(regexp_extract_all(right(t, 300), '#### (-?[0-9.,]+)', 1)[-1], ',', '') AS strict, list_filter(regexp_extract_all(right(t, 300), '(-?[0-9.,]+)', 1), lambda x: x <> '' AND x <> '.')[-1] AS flexible FROM s""")
def x07(spark, sf):
    mark = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("#### 1,"), F.col("user_id").cast("string"), F.lit(" ")))
    t = F.concat(F.lit("so "), F.col("value").cast("string"), F.lit(" then "), mark, F.lit("end."))
    return table(spark, sf, "events").select("event_id", tx.hash_answer(t).alias("strict"), tx.hash_answer(t, True).alias("flexible"))


@query("X08_search_score", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 WHEN event_type <> 'view' THEN 0.1 WHEN event_id % 7 = 0 THEN 0.25 ELSE 1.0 END AS score FROM events""")
def x08(spark, sf):
    e = F.col("event_type")
    many = F.when(F.col("event_id") % 7 == 0, F.repeat(F.lit("<answer>x</answer>"), F.lit(11))).otherwise("")
    t = F.when(F.col("event_id") % 5 == 0, F.lit("no tag")).otherwise(F.concat(many, F.lit("<answer> The "), e, F.lit("!</answer>")))
    return table(spark, sf, "events").select("event_id", tx.search_score(t, F.array(F.lit("a view"), F.lit("nothing")), format_score=0.1).alias("score"))


@query("X09_boxed_answer", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE '{' || CAST(user_id AS VARCHAR) || '}+1' END AS boxed FROM events")
def x09(spark, sf):
    t = F.concat(F.lit("a \\boxed{0} b \\boxed{{"), F.col("user_id").cast("string"), F.lit("}+1} c"))
    return table(spark, sf, "events").select("event_id", tx.boxed_udf(F.when(F.col("event_id") % 4 == 0, F.lit("none")).otherwise(t)).alias("boxed"))


@query("X10_final_answer", "SELECT event_id, CAST(user_id AS VARCHAR) || '000' AS answer FROM events")
def x10(spark, sf):
    t = F.concat(F.lit("x = the $\\text{"), F.col("user_id").cast("string"), F.lit(",000}$ dollars"))
    return table(spark, sf, "events").select("event_id", tx.final_answer_udf(t).alias("answer"))


@query("X10_minerva", "SELECT event_id, event_id % 2 = 0 AND event_id % 5 <> 0 AS correct, event_id % 2 = 0 AND event_id % 5 <> 0 AS boxed, CASE WHEN event_id % 5 = 0 THEN '[INVALID]' ELSE CAST(user_id AS VARCHAR) || '000' END AS answer FROM events")
def x10_minerva(spark, sf):
    u, end = F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "000").otherwise("001")
    line = F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("Answer: 1\nanswer : x = $\\text{"), u, F.lit(",000}$ dollars\nEnd")))
    m = tx.minerva_udf(line, F.concat(u, end))
    boxed = tx.minerva_boxed_udf(line, F.concat(F.lit("so \\boxed{"), u, F.lit(","), end, F.lit("}.")))
    rows = table(spark, sf, "events").select("event_id", m.alias("m"), boxed.alias("b"))
    return rows.select("event_id", F.col("m.correct").alias("correct"), F.col("b.correct").alias("boxed"), F.col("m.answer").alias("answer"))


@query("X10_strict_box", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1 ELSE -1 END AS score, CASE WHEN event_id % 4 < 2 THEN CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) || '.0' END END AS answer FROM events")
def x10_strict(spark, sf):
    u, m = F.col("user_id").cast("string"), F.col("event_id") % 4
    box = F.concat(F.lit("\\boxed{0} then \\boxed{"), u, F.when(m == 1, ".0").otherwise(""), F.lit("}"))
    text = F.when(m < 2, box).when(m == 2, F.concat(box, F.lit("." * 100))).otherwise(F.concat(F.lit("\\boxed{"), u))
    return table(spark, sf, "events").select("event_id", tx.strict_box_udf(text, u).alias("s")).select("event_id", "s.score", "s.answer")


@query("X11_latex_marks", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN user_id = 50 WHEN 1 THEN true WHEN 2 THEN user_id < 10 WHEN 3 THEN true WHEN 4 THEN user_id % 2 = 0 ELSE user_id = 0 END AS equal FROM events""")
def x11_marks(spark, sf):
    u, m = F.col("user_id").cast("string"), F.col("event_id") % 6
    # a bare percent sign counts, an escaped one doesn't; roots take one character; units, names and decimals go
    a = F.when(m == 0, F.lit("50\\%")).when(m == 1, F.concat(u, F.lit("\\%"))).when(m == 2, F.concat(F.lit("\\sqrt"), u)).when(m == 3, F.concat(F.lit("x = "), u, F.lit("\\text{ cm}")))
    a = a.when(m == 4, F.concat(F.lit("."), F.when(F.col("user_id") % 2 == 0, "5").otherwise("7"))).otherwise(F.concat(u, F.lit("%")))
    b = F.when(m == 0, u).when(m == 1, u).when(m == 2, F.concat(F.lit("\\sqrt{"), u, F.lit("}"))).when(m == 3, u).when(m == 4, F.lit("\\dfrac12")).otherwise(F.lit("0%"))
    return table(spark, sf, "events").select("event_id", tx.latex_equal_udf(a, b).alias("equal"))


@query("X11_latex_equal", "SELECT event_id, user_id % 10 = event_id % 10 AS equal FROM events")
def x11(spark, sf):
    a = F.concat((F.col("user_id") % 10).cast("string"), F.lit("/7"))
    b = F.concat(F.lit("\\dfrac{ "), (F.col("event_id") % 10).cast("string"), F.lit("}{7}\\!"))
    return table(spark, sf, "events").select("event_id", tx.latex_equal_udf(a, b).alias("equal"))


@query("X12_dispatch", "SELECT event_id, round(CASE event_type WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN 'click' THEN value ELSE -1.0 END, 4) AS score FROM events")
def x12(spark, sf):
    e = F.col("event_type")
    scorers = {"view": (F.col("user_id") % 2 == 0).cast("double"), "click": F.col("value"), "purchase": F.lit(-1.0), "signup": F.lit(-1.0), "error": F.lit(-1.0)}
    return table(spark, sf, "events").select("event_id", F.round(extend.dispatched(e, scorers), 4).alias("score"))


@query("X13_format_reward", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS think, CASE WHEN event_id % 3 = 1 THEN 1.0 ELSE 0.0 END AS react FROM events")
def x13(spark, sf):
    m = F.col("event_id") % 3
    t = F.when(m == 0, F.lit("<think>a\nb</think>\n<answer>c</answer>")).when(m == 1, F.lit("Action: x\nAction Input: y")).otherwise(F.lit("<think>a</think> c"))
    return table(spark, sf, "events").select("event_id", tx.format_reward(t).alias("think"), tx.react_reward(t).alias("react"))


@query("X14_cosine_length", "SELECT doc_id, round(CASE WHEN lang = 'en' THEN 1.0 - (1.0 - 0.5) * (1 - cos(n_chars * pi() / 40000)) / 2 ELSE -0.5 + 0.5 * (1 - cos(n_chars * pi() / 40000)) / 2 END, 6) + 0.0 AS reward FROM documents")
def x14(spark, sf):
    r = tx.cosine_length_reward(F.col("lang") == "en", F.col("n_chars"), 40000)
    return table(spark, sf, "documents").select("doc_id", (F.round(r, 6) + 0.0).alias("reward"))


@query("X15_repetition", r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM benchmark),
g AS (SELECT item_id, len(ws) AS n, list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i:i + 2], ' ')) AS gs FROM w)
SELECT item_id, round(CASE WHEN n < 3 THEN 0 ELSE (1 - len(list_distinct(gs)) / len(gs)) * -0.5 END, 6) + 0.0 AS penalty FROM g""")
def x15(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", (F.round(tx.repetition_penalty(F.col("text"), 3, -0.5), 6) + 0.0).alias("penalty"))


@query("X16_soft_overlong", "SELECT doc_id, round(least(-(n_chars - (8000 - 2000)) / 2000, 0), 6) + 0.0 AS reward FROM documents")
def x16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.round(tx.soft_overlong(F.col("n_chars"), 8000, 2000), 6) + 0.0).alias("reward"))


@query("X17_overlong_factor", "SELECT doc_id, round(least(-(n_chars - (8000 - 2000)) / 2000 * 0.5, 0), 6) + 0.0 AS reward FROM documents")
def x17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.round(tx.soft_overlong(F.col("n_chars"), 8000, 2000, 0.5), 6) + 0.0).alias("reward"))


@query("X18_list_similarity", """
WITH s AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_partkey, l_suppkey) FILTER (l_returnflag = 'A') AS a, list(l_linenumber ORDER BY l_partkey, l_suppkey) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s),
u AS (SELECT l_orderkey, v, sum(i) AS i, sum(j) AS j FROM (SELECT l_orderkey, unnest(a) AS v, 1 AS i, 0 AS j FROM r UNION ALL SELECT l_orderkey, unnest(b), 0, 1 FROM r) GROUP BY ALL),
c AS (SELECT l_orderkey, sum(least(i, j)) AS c FROM u GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN a = b THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE coalesce(c, 0) / (len(a) + len(b) - coalesce(c, 0)) END, 6) AS similarity FROM r LEFT JOIN c USING (l_orderkey)""")
def x18(spark, sf):
    side = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == f, F.struct("l_partkey", "l_suppkey", "l_linenumber")))), lambda x: x["l_linenumber"])
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(side("A").alias("a"), side("R").alias("b"))
    return s.select("l_orderkey", F.round(tx.list_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("X19_tool_call_match", "SELECT event_id, round(CASE WHEN user_id = event_id % 150 THEN 3.0 ELSE 6.0 * (1 + 1 + 1) / (1 + 1 + 2) - 3.0 END, 4) AS score FROM events")
def x19(spark, sf):
    call = lambda v: F.to_json(F.array(F.struct(F.lit("f").alias("name"), F.struct(v.alias("x"), F.lit(1).alias("y")).alias("parameters"))))
    return table(spark, sf, "events").select("event_id", F.round(tx.tool_call_udf(call(F.col("user_id")), call(F.col("event_id") % 150)), 4).alias("score"))


@query("X20_lenient_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def x20(spark, sf):
    k = F.get_json_object("props", "$.k")
    broken = F.concat(F.lit("```json\n{k: "), k, F.lit(', "z": [1, 2,], "o": {"p": 1'))
    return table(spark, sf, "events").select("event_id", F.get_json_object(tx.repaired_json(broken), "$.k").cast("long").alias("k"))


@query("X21_json_span", "SELECT event_id, props AS span FROM events")
def x21(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.json_span(F.concat(F.lit("so\n"), "props", F.lit("\nend"))).alias("span"))


@query("X22_tool_calls", "SELECT event_id, event_type AS name, user_id AS arg, 1 AS k FROM events UNION ALL SELECT event_id, 'stop', NULL, 2 FROM events WHERE event_id % 2 = 0")
def x22(spark, sf):
    from braidwork.functions import tools

    body = F.to_json(F.struct(F.col("event_type").alias("name"), F.struct(F.col("user_id").alias("id")).alias("arguments")))
    more = F.when(F.col("event_id") % 2 == 0, F.lit('<tool_call>{"name": "stop", "arguments": {}}</tool_call>')).otherwise("")
    t = F.concat(F.lit("I will <tool_call>\n"), body, F.lit("\n</tool_call>"), more)
    calls = table(spark, sf, "events").select("event_id", F.posexplode(tools.parsed("hermes", t)["calls"]).alias("i", "c"))
    return calls.select("event_id", F.col("c.name").alias("name"), F.get_json_object("c.arguments", "$.id").cast("long").alias("arg"), (F.col("i") + 1).alias("k"))


@query("X22_tool_formats", """
SELECT event_id, unnest(['glm', 'seed', 'minimax', 'kimi', 'gemma4', 'qwen3_coder', 'gpt-oss']) AS format, 'I will ' AS content, event_type AS name, '{"id": ' || user_id || ', "ok": true}' AS arguments FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, unnest(['glm', 'seed', 'minimax', 'kimi', 'gemma4', 'qwen3_coder', 'gpt-oss']), 'no call', NULL, NULL FROM events WHERE event_id % 2 = 1""")
def x22_formats(spark, sf):
    from braidwork.functions import tools

    name, arg = F.col("event_type"), F.col("user_id").cast("string")
    made = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    tags = ("<parameter=id>", arg, "</parameter><parameter=ok>true</parameter></function>")
    body = made('{"id": ', arg, ', "ok": true}')
    texts = {
        "glm": made("<think>call:no</think>I will <tool_call>", name, "<arg_key>id</arg_key><arg_value>", arg, "</arg_value>\n<arg_key>ok</arg_key><arg_value>true</arg_value></tool_call>"),
        "seed": made("I will <seed:tool_call><function=", name, ">", *tags, "</seed:tool_call>"),
        "minimax": made('I will <minimax:tool_call><invoke name="', name, '"><parameter name="id">', arg, '</parameter><parameter name="ok">true</parameter></invoke></minimax:tool_call>'),
        "kimi": made("I will <|tool_calls_section_begin|><|tool_call_begin|>functions.", name, ":0<|tool_call_argument_begin|>", body, "<|tool_call_end|><|tool_calls_section_end|>"),
        "gemma4": made("I will <|tool_call>call:", name, "{id:", arg, ",ok:true}<tool_call|>"),
        "qwen3_coder": made("I will <tool_call>\n<function=", name, ">\n", *tags, "\n</tool_call>"),
        "gpt-oss": made("<|channel|>analysis<|message|><|start|>assistant<|channel|>x to=functions.no <|constrain|>json<|message|>{}<|call|><|end|>I will <|start|>assistant<|channel|>commentary to=functions.", name, " <|constrain|>json<|message|>", body, "<|call|>"),
    }
    kinds = {n: {"properties": {"id": {"type": "integer"}, "ok": {"type": "boolean"}}, "required": ["id"]} for n in ("view", "click", "purchase", "signup", "error")}
    events = table(spark, sf, "events")
    out = None
    for form, text in texts.items():
        said = F.when(F.col("event_id") % 2 == 0, text).otherwise(F.lit("no call"))
        rows = events.select("event_id", F.lit(form).alias("format"), tools.parsed(form, said, kinds).alias("p"))
        rows = rows.select("event_id", "format", "p.content", F.explode_outer("p.calls").alias("c"))
        rows = rows.select("event_id", "format", "content", "c.name", "c.arguments")
        out = rows if out is None else out.unionByName(rows)
    return out


def parsed_plans(spark, sf):
    """Events of a user as the calls of a plan, those of an hour in one step, rendered and parsed back."""
    from braidwork.functions import tools

    call = F.struct(F.col("event_type").alias("name"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("arguments"))
    turns = table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.array_sort(F.collect_list(call)).alias("calls"))
    plans = turns.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "calls"))), lambda x: x["calls"]).alias("steps"))
    parsed = plans.select("user_id", F.explode(tools.parse_plan(tools.render_plan(F.col("steps")))).alias("p"))
    return parsed.select("user_id", F.get_json_object("p.argument", "$.id").cast("long").alias("event_id"), F.col("p.name").alias("name"), F.col("p.step").alias("step"))


@query("X23_plan_grammar", "SELECT user_id, count(*) AS steps, max(event_id) AS last FROM events GROUP BY 1")
def x23(spark, sf):
    return parsed_plans(spark, sf).groupBy("user_id").agg(F.count("*").alias("steps"), F.max("event_id").alias("last"))


@query("X23_plan_steps", "SELECT user_id, event_id, event_type AS name, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts)) AS INT) AS step FROM events")
def x23_steps(spark, sf):
    return parsed_plans(spark, sf)


@query("X24_advice_kind", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'tool_chain' ELSE 'advice' END AS type,
  CASE event_type WHEN 'view' THEN '[Reference plan] ' || user_id WHEN 'error' THEN 'Plain ' || user_id WHEN 'click' THEN 'Do ' || user_id || chr(10) || 'then stop' ELSE 'This task is within your ability and can be solved directly.' END AS body,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' ELSE 'corrective' END AS kind FROM events""")
def x24(spark, sf):
    e, u = F.col("event_type"), F.col("user_id").cast("string")
    tail = F.when(F.col("event_id") % 2 == 0, F.lit("\n\nNotice: go")).otherwise(F.lit("\n\n[User Question]\nwhat? # Advice: no"))
    text = F.when(e == "view", F.concat(F.lit("[Reference plan] "), u)).when(e == "error", F.concat(F.lit("Plain "), u))
    text = text.when(e == "click", F.concat(F.lit("[Expert advice]\n# Advice:\n Do "), u, F.lit("\nthen stop "))).otherwise(F.lit(f"[Expert advice] # Advice: {payloads.SOLVED_MARK}"))
    prompt = F.concat(text, tail)
    body = payloads.advice_body(prompt)
    return table(spark, sf, "events").select("event_id", payloads.prompt_type(prompt).alias("type"), body.alias("body"), payloads.advice_kind(body).alias("kind"))


@query("X25_code_block", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x = ' || CAST(user_id AS VARCHAR) ELSE 'plain' END AS code FROM events")
def x25(spark, sf):
    code = F.concat(F.lit("<think>```py\nno\n```</think>first ```\nold\n``` then ```python\nx = "), F.col("user_id").cast("string"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", tx.code_block(F.when(F.col("event_id") % 2 == 0, code).otherwise(F.lit("<think>hm</think> plain "))).alias("code"))


@query("X26_longest_code", "SELECT event_id, 'x = ' || CAST(user_id AS VARCHAR) || chr(10) || 'y = x' AS code FROM events")
def x26(spark, sf):
    t = F.concat(F.lit("Here is it:\nx = "), F.col("user_id").cast("string"), F.lit("\ny = x\nThat is all of it"))
    return table(spark, sf, "events").select("event_id", tx.longest_code_udf(t).alias("code"))


@query("X26_code_runs", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a = ' || user_id || chr(10) || 'b = 2' || chr(10) || 'c = 3' WHEN 1 THEN chr(10) || 'x = ' || user_id ELSE 'only words' END AS code FROM events")
def x26_runs(spark, sf):
    u, m = F.col("user_id").cast("string"), F.col("event_id") % 3
    t = F.when(m == 0, F.concat(F.lit("x = 1\n\n\n\ny = 2\n??? no\na = "), u, F.lit("\nb = 2\nc = 3"))).when(m == 1, F.concat(F.lit("some words\n\nx = "), u, F.lit("\nmore words here"))).otherwise(F.lit("only words"))
    return table(spark, sf, "events").select("event_id", tx.longest_code_udf(t).alias("code"))


@query("X27_test_payload", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS cases, CASE event_id % 6 WHEN 2 THEN event_type END AS fn_name FROM events")
def x27(spark, sf):
    m, e = F.col("event_id") % 6, F.col("event_type")
    body = F.when(m == 0, F.lit('{"inputs": ["1"], "outputs": ["1", "2"]}')).when(m == 1, F.lit('{"inputs": ["1", "2"], "outputs": ["1", "2"]}')).when(m == 2, F.concat(F.lit('{"inputs": [[1]], "outputs": [2], "fn_name": "'), e, F.lit('"}')))
    body = body.when(m == 3, F.lit('{"inputs": [], "outputs": []}')).when(m == 4, F.lit('{"inputs": ["1"], "outputs": ["1"], "fn_name": " "}')).otherwise(F.lit("{broken"))
    rows = table(spark, sf, "events").select("event_id", payloads.parsed_tests(body).alias("p"))
    return rows.select("event_id", F.when(F.col("p").isNotNull(), F.size("p.inputs")).alias("cases"), "p.fn_name")


@query("X28_decode_tests", """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN '[{"input": "' || user_id || '", "output": "é ' || event_type || '"}]' END AS tests FROM events""")
def x28(spark, sf):
    m = F.col("event_id") % 3
    plain = F.concat(F.lit('[{"input": "'), F.col("user_id").cast("string"), F.lit('", "output": "é '), "event_type", F.lit('"}]'))
    raw = F.when(m == 0, plain).when(m == 1, payloads.encoded_tests(plain)).otherwise(F.lit("aGVsbG8="))
    return table(spark, sf, "events").select("event_id", payloads.decoded_tests(raw).alias("tests"))


@query("X29_finance_match", "SELECT event_id, CASE WHEN user_id = 0 THEN 1.0 WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 3 = 1 THEN 1.0 ELSE CASE WHEN user_id * 0.05 <= user_id * 0.01 THEN 1.0 ELSE 0.0 END END AS score FROM events")
def x29(spark, sf):
    u, m = F.col("user_id").cast("string"), F.col("event_id") % 3
    p = F.when(m == 0, F.concat(u, F.lit("%"))).when(m == 1, F.concat(F.lit("$"), u, F.lit(".00"))).otherwise((F.col("user_id") * 1.05).cast("string"))
    t = F.when(m == 0, F.concat(F.lit("\\boxed{"), u, F.lit(".0\\%}"))).otherwise(u)
    return table(spark, sf, "events").select("event_id", tx.finance_udf(p, t).alias("score"))


@query("X30_float_compare", "SELECT event_id, abs(value - (value + user_id * 1e-7)) <= greatest(1e-6 * greatest(abs(value), abs(value + user_id * 1e-7)), 1e-6) AS same, value AS unwrapped FROM events")
def x30(spark, sf):
    v = F.col("value")
    text = F.concat(F.lit("Decimal('"), v.cast("string"), F.lit("')"))
    return table(spark, sf, "events").select("event_id", tx.close(v, v + F.col("user_id") * 1e-7).alias("same"), tx.unwrap_decimal(text).alias("unwrapped"))


@query("X31_truthy", "SELECT event_id, CASE user_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS ok FROM events")
def x31(spark, sf):
    from braidwork.operators.metrics import truthy

    m = F.col("user_id") % 5
    s = F.when(m == 0, " TRUE ").when(m == 1, "y").when(m == 2, "No").when(m == 3, "0").otherwise("?")
    return table(spark, sf, "events").select("event_id", truthy(s).alias("ok"))


_E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS same, a.e AS x, b.e AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


def vector_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"), F.col("label").alias("l2"))
    return e.join(b, "vec_id").select("vec_id", (F.col("label") == F.col("l2")).cast("int").alias("same"), F.col("embedding").alias("x"), "y")


@query("X32_paired_similarity", _E + " SELECT vec_id, round(list_cosine_similarity(x, y), 5) AS cosine, round(-list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))), 4) AS l1, round(-list_distance(x, y), 5) AS l2, round(list_inner_product(x, y), 4) + 0.0 AS dot FROM p")
def x32(spark, sf):
    from braidwork.operators.retrieval import dot, norm

    d = lambda f: F.aggregate(F.zip_with("x", "y", f), F.lit(0.0), lambda s, v: s + v)
    l1 = d(lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    l2 = F.sqrt(d(lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)))
    return vector_pairs(spark, sf).select("vec_id", F.round(dot("x", "y") / (norm("x") * norm("y")), 5).alias("cosine"), F.round(-l1, 4).alias("l1"), F.round(-l2, 5).alias("l2"), (F.round(dot("x", "y"), 4) + 0.0).alias("dot"))


@query("X32_rank_correlation", _E + """, s AS (SELECT vec_id, same, list_cosine_similarity(x, y) AS c FROM p), r AS (SELECT c, same, (rank() OVER (ORDER BY c)) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc, (rank() OVER (ORDER BY same)) + (count(*) OVER (PARTITION BY same) - 1) / 2.0 AS rs FROM s)
SELECT round(corr(c, same), 4) AS pearson, round(corr(rc, rs), 4) AS spearman FROM r""")
def x32_rank(spark, sf):
    from braidwork.operators.quantiles import average_ranks
    from braidwork.operators.retrieval import dot, norm

    s = vector_pairs(spark, sf).select("same", (dot("x", "y") / (norm("x") * norm("y"))).alias("c"))
    both = s.join(average_ranks(s, "c", "r_c"), "c").join(average_ranks(s, "same", "r_same"), "same")
    return both.agg(F.round(F.corr("c", "same"), 4).alias("pearson"), F.round(F.corr("r_c", "r_same"), 4).alias("spearman"))


@query("X33_info_nce", """
SELECT user_id, round(max(CASE WHEN event_type = 'view' THEN value END) - max(CASE WHEN event_type <> 'view' THEN value END), 4) + 0.0 AS margin, max(CASE WHEN event_type = 'view' THEN value END) > max(CASE WHEN event_type <> 'view' THEN value END) AS top1,
  round(avg(CASE WHEN event_type = 'view' THEN value END), 4) AS mean_pos, round(avg(CASE WHEN event_type <> 'view' THEN value END), 4) AS mean_neg FROM events GROUP BY 1""")
def x33(spark, sf):
    out = payloads.info_nce(table(spark, sf, "events"), "user_id", "value", F.col("event_type") == "view")
    return out.select("user_id", (F.round("margin", 4) + 0.0).alias("margin"), "top1", F.round("mean_pos", 4).alias("mean_pos"), F.round("mean_neg", 4).alias("mean_neg"))


@query("X34_token_accuracy", """
WITH s AS (SELECT l_orderkey, list(CASE WHEN l_linenumber = 3 THEN -100 ELSE l_linenumber END ORDER BY l_partkey, l_suppkey) AS labels, list(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END ORDER BY l_partkey, l_suppkey) AS preds FROM lineitem GROUP BY 1),
z AS (SELECT l_orderkey, list_filter(list_transform(range(1, len(labels)), lambda i: CASE WHEN labels[i + 1] <> -100 THEN preds[i] = labels[i + 1] END), lambda x: x IS NOT NULL) AS hits FROM s)
SELECT l_orderkey, round(len(list_filter(hits, lambda x: x)) / nullif(len(hits), 0), 4) AS token_acc, len(list_filter(hits, lambda x: NOT x)) = 0 AS seq_acc FROM z""")
def x34(spark, sf):
    n = F.col("l_linenumber")
    pair = F.struct("l_partkey", "l_suppkey", F.when(n == 3, -100).otherwise(n).alias("label"), F.when(F.col("l_returnflag") == "A", n).otherwise(0).alias("pred"))
    seqs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pair)).alias("ts"))
    hits = payloads.label_hits(F.transform("ts", lambda t: t["pred"]), F.transform("ts", lambda t: t["label"]))
    return seqs.select("l_orderkey", F.round(payloads.token_accuracy(hits), 4).alias("token_acc"), payloads.sequence_accuracy(hits).alias("seq_acc"))


@query("X36_loss_weights", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END AS default_weight, CASE WHEN role = 'assistant' AND turn > last_user THEN 1.0 ELSE 0.0 END AS last_round, 1.0 AS all_weight FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last_user FROM conversations)""")
def x36(spark, sf):
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    own = F.col("role") == "assistant"
    rows = table(spark, sf, "conversations").withColumn("last_user", last)
    return rows.select("conv_id", "turn", own.cast("double").alias("default_weight"), F.coalesce(own & (F.col("turn") > F.col("last_user")), F.lit(False)).cast("double").alias("last_round"), F.lit(1.0).alias("all_weight"))


@query("X36_weight_map", """
SELECT event_id, 'delimiter' AS kind, unnest([0, 1, 2, 3, 4]) AS i, unnest(['x ', 'Action:', event_type, 'Result:', CAST(user_id AS VARCHAR)]) AS content, CAST(unnest([1, 2, 3, 0, 0.5]) AS DOUBLE) AS weight FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'delimiter', 0, 'x Action:error' || 'Result:' || CAST(user_id AS VARCHAR), 0.25 FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'regex', unnest([0, 1, 2]), unnest(['x ', 'Action:' || event_type || 'Result:', CAST(user_id AS VARCHAR)]), CAST(unnest([1, 4, 1]) AS DOUBLE) FROM events""")
def x36_map(spark, sf):
    t = F.concat(F.lit("x Action:"), "event_type", F.lit("Result:"), F.col("user_id").cast("string"))
    maps = {"delimiter": tx.weight_map_udf({"Action:": [2, 3], "Result:": [0, 0.5], "x": [9]}, {"error": [0.25]}), "regex": tx.weight_map_udf({"Action:.*?Result:": [4]})}
    parts = [table(spark, sf, "events").select("event_id", F.lit(kind).alias("kind"), F.posexplode(f(F.col("event_type"), t)).alias("i", "p")) for kind, f in maps.items()]
    return parts[0].unionByName(parts[1]).select("event_id", "kind", "i", "p.content", "p.weight")


@query("X37_rubrics", "SELECT event_id, round(CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END * 0.25 + CASE WHEN user_id % 2 = 0 THEN value / 500 ELSE 0 END * 0.75, 6) AS weighted, round(CASE WHEN value / 500 < 0.1 THEN 0.0 ELSE value / 500 END, 6) AS gated, round(CASE WHEN user_id % 2 = 1 THEN 0.0 ELSE value / 500 END, 6) AS sequential FROM events")
def x37(spark, sf):
    from braidwork.functions import rubrics

    v = F.col("value") / 500
    even = (F.col("user_id") % 2 == 0).cast("double")
    weighted = rubrics.weighted_sum([((F.col("value") >= 20).cast("double"), 0.25), (v * even, 0.75)])
    return table(spark, sf, "events").select("event_id", F.round(weighted, 6).alias("weighted"), F.round(rubrics.gate(v, 0.1), 6).alias("gated"), F.round(rubrics.sequential([even, v]), 6).alias("sequential"))


@query("X38_session_keys", "SELECT o_orderkey, 'u_' || o_custkey AS uid, o_orderstatus AS session, CAST(o_orderkey AS VARCHAR) AS index FROM orders")
def x38(spark, sf):
    key = F.concat(F.lit("u_"), F.col("o_custkey").cast("string"), F.lit("_"), "o_orderstatus", F.lit("_"), F.col("o_orderkey").cast("string"))
    part = lambda i: F.regexp_extract(key, "^(.*)_([^_]*)_([^_]*)$", i)
    return table(spark, sf, "orders").select("o_orderkey", part(1).alias("uid"), part(2).alias("session"), part(3).alias("index"))


@query("X39_cache_keys", "SELECT doc_id, sha256(text) AS key FROM documents")
def x39(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))


@query("X40_environment_reward", "SELECT user_id, max_by(value, event_id) AS reward FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def x40(spark, sf):
    from braidwork.functions import rubrics

    traced = F.when(F.col("event_type").isin("view", "click"), F.col("value"))
    by = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", traced.alias("r")))), lambda x: x["r"]).alias("trace"))
    return by.select("user_id", rubrics.resolve_reward(F.col("trace"), F.lit(None).cast("double")).alias("reward"))
