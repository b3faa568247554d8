"""Hand-computed cases of single operators."""

import ast
import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.functions import extend, rubrics, tools
from braidwork.functions import text as tx
from braidwork.operators import curation, groups, messages, metrics, packing, relational, retrieval, sampling
from braidwork.sources import files
from braidwork.streaming import buffer


def test_group_stats_singleton_and_floor(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, v double")
    got = {r["g"]: (r["mean"], r["std"], r["count"]) for r in groups.group_stats(df, "g", "v").collect()}
    assert got == {"a": (2.0, pytest.approx(math.sqrt(2)), 2), "b": (0.0, 1.0, 1)}
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "g string, v double")
    assert groups.group_stats(flat, "g", "v", eps=0.25).first()["std"] == 0.5
    assert groups.group_stats(df.limit(0), "g", "v").count() == 0


def test_group_codes(spark):
    def codes(values, kind):
        df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
        return {r["x"]: r["code"] for r in groups.group_codes(df, "x").collect()}

    mixed = codes(["a", "b", "a", "c", "0042", "42", None], "string")
    assert len(set(mixed.values())) == 6 and mixed[None] is None and mixed["0042"] == 0
    assert codes(["7", "3"], "string") == {"7": 7, "3": 3} and codes([7, 3], "long") == {7: 7, 3: 3}
    assert len(set(codes([1.0000001, 2.0, 1.0, 3.0000000001], "double").values())) == 3
    assert codes([], "string") == {}


def test_advantages(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, r double")
    got = sorted((r["g"], r["r"], round(r["advantage"], 3)) for r in groups.advantages(df, "g", "r").collect())
    assert got == [("a", 1.0, -0.707), ("a", 3.0, 0.707), ("b", 5.0, 0.0)]
    loo = sorted(round(r["advantage"], 3) for r in groups.advantages(df, "g", "r", "rloo", "none").collect())
    assert loo == [-2.0, 0.0, 2.0]


def test_weighted_reward_ignores_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (None, 2.0)], "a double, b double")
    assert sorted(r["reward"] for r in groups.weighted_reward(df, ["a", "b"], [1.0, 0.5]).collect()) == [1.0, 1.0]


def test_weighted_metrics(spark):
    rows = [
        (1, "actor/pg_loss/mean", 1.0, 1), (2, "actor/pg_loss/mean", 3.0, 3), (1, "actor/kl", 2.0, 1), (2, "actor/kl", 4.0, 3),
        (1, "grad/max", 1.0, 1), (2, "grad/max", 5.0, 1), (1, "timing_s/update_actor", 1.5, 1), (2, "timing_s/update_actor", 2.5, 1),
        (1, "some/total_tokens", 10.0, 1), (2, "some/total_tokens", 20.0, 1), (1, "training/global_step", 7.0, 1), (2, "training/global_step", 8.0, 1),
        (1, "training/off_policy/dropped_samples", 2.0, 1), (2, "training/off_policy/dropped_samples", 3.0, 1), (1, "x/max/mean", 1.0, 1), (2, "x/max/mean", 5.0, 3),
    ]
    df = spark.createDataFrame(rows, "step int, name string, value double, weight int")
    got = {r["name"]: r["value"] for r in metrics.reduce_metrics(df, metrics.weighted_rule(F.col("name"))).collect()}
    assert got["actor/pg_loss/mean"] == 2.5 and got["actor/kl"] == 3.5 and got["grad/max"] == 5 and got["timing_s/update_actor"] == 4
    assert got["some/total_tokens"] == 30 and got["training/global_step"] == 8 and got["training/off_policy/dropped_samples"] == 5 and got["x/max/mean"] == 5
    other = {r["name"]: r["value"] for r in metrics.reduce_metrics(df, metrics.async_rule(F.col("name"))).collect()}
    assert other["x/max/mean"] == 3.0


def test_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 9, 3)], "v long")
    r = metrics.upper_median(df, "v", "v").first()
    assert (r["rows"], r["max"], r["upper_median"]) == (4, 9, 5)


def test_choose_round(spark):
    rows = [
        ("0", 1, 1.0, True, 0), ("1", 1, 0.2, False, 0), ("1", 2, 1.0, True, 0), ("2", 1, 0.2, False, 0), ("2", 2, 0.4, False, 0), ("2", 3, 0.7, False, 0),
        ("3", 1, 0.5, False, 0), ("3", 2, 0.5, False, 0), ("4", 1, 0.1, False, 0), ("4", 2, 0.8, False, 1),
    ]
    df = spark.createDataFrame(rows, "task string, round int, score double, complete boolean, errors int")
    got = {r["task"]: (r["kind"], r["source"], r["target"]) for r in curation.choose_round(df, "task", "round", "score", "complete", "errors").collect()}
    assert got == {"0": ("complete_first_try", None, 1), "1": ("complete_after_refine", None, 2), "2": ("improved_partial", 2, 3)}


def test_merged_periods_touch_and_contain(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 2, 3), ("a", 9, 12), ("a", 12, 13), ("a", 20, 21)], "g string, s int, e int")
    assert sorted((r["s"], r["e"]) for r in relational.merged_periods(df, "g", "s", "e").collect()) == [(0, 13), (20, 21)]


def test_checked_union_fails_on_shared_keys(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="share keys"):
        relational.checked_union(a, a, "k").collect()


def test_page(spark):
    df = spark.range(10).withColumnRenamed("id", "v")
    got = relational.page(df, ["v"], 4, 3).collect()
    assert [r["v"] for r in got] == [4, 5, 6] and got[0]["has_more"]
    assert not relational.page(df, ["v"], 8, 3).first()["has_more"]


@given(st.lists(st.integers(1, 50), max_size=60))
def test_packing_invariants(lengths):
    for fold in (packing.next_fit, packing.best_fit):
        packs = {}
        for n, p in zip(lengths, fold(lengths, 50)):
            packs.setdefault(p, []).append(n)
        assert sum(map(len, packs.values())) == len(lengths)
        assert all(sum(x) <= 50 for x in packs.values())
    assert packing.next_fit(lengths, 50) == sorted(packing.next_fit(lengths, 50))


@pytest.mark.parametrize("equal", [False, True])
def test_differencing(equal):
    lengths = [100, 200, 150, 50, 300, 250, 120, 80]
    parts = packing.differencing(lengths, 2, equal)
    sums = [sum(n for n, p in zip(lengths, parts) if p == j) for j in (0, 1)]
    assert abs(sums[0] - sums[1]) <= max(lengths) and (not equal or parts.count(0) == 4)
    with pytest.raises(ValueError):
        packing.differencing([1], 2)


def test_greedy_ties_go_to_the_first():
    assert packing.greedy([5, 5, 1, 1], 2) == [0, 1, 0, 1]


def test_padding(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = packing.padded(df, 8, "k")
    assert out.count() == 16 and out.filter("is_padding").count() == 6
    assert packing.padded(spark.range(16).withColumnRenamed("id", "k"), 8, "k").count() == 16
    assert packing.padded(spark.range(3).withColumnRenamed("id", "k"), 8, "k").count() == 8


def test_sampling_properties(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert sampling.sample_repeating(df, "k", 250).count() == 250
    parts = {r["part"]: r["count"] for r in sampling.split(df, "k", 0.07).groupBy("part").count().collect()}
    assert parts == {"train": 93, "val": 7}
    assert sorted(r["ordinal"] for r in sampling.shuffled(df, "k").collect()) == list(range(100))


def test_locator():
    at = files.parse_locator("hf::org/name:a/b#20")
    assert (at.hub, at.name, at.subsets, at.rows) == ("hf", "org/name", ("a", "b"), 20)
    assert files.parse_locator("/data/x:y#3", lambda p: p == "/data/x:y#3").name == "/data/x:y#3"
    assert files.select_subsets([files.Subset("a"), files.Subset("b", weak=True)], ("all",)) == ["a"]


def test_guards(spark):
    t = {"t": spark.range(3)}
    for bad in ("SELECT * FROM {t} WHERE id > 1", "SELECT id FROM {t}", "DROP TABLE x", "SELECT id FROM {t} WHERE id > 1; SELECT 1"):
        with pytest.raises(ValueError):
            files.guarded_sql(spark, t, bad)
    assert files.guarded_sql(spark, t, "SELECT id FROM {t} WHERE id > 1").count() == 1


@pytest.mark.parametrize(
    ("predicted", "truth", "score"),
    [("6.12", "6.118", 1), ("6.1", "6.118", 1), ("5.0", "6.118", 0), ("6.28%", "\\boxed{6.280\\%}", 1), ("0.0628", "\\boxed{6.280\\%}", 1), ("1, 2", "\\boxed{1} and \\boxed{2}", 1), ("(100)", "-100", 1), ("1/2", "0.5", 1), ("0.0005", "0", 1)],
)
def test_finance(predicted, truth, score):
    assert tx.finance_match(predicted, truth) == score


def test_finance_numbers():
    assert [tx.finance_number(x) for x in ("1,234.56", "20%", "1/2", "", None, "x")] == [1234.56, 0.2, 0.5, None, None, None]


def test_boxed_and_latex():
    assert tx.boxed("a \\boxed{\\frac{1}{2}} b") == "\\frac{1}{2}" and tx.boxed("none") is None
    assert tx.latex_equal("1/2", "\\dfrac{1}{2}") and not tx.latex_equal("1/3", "0.5") and tx.latex_equal("0.5", "\\frac12")
    assert tx.longest_code("hello there\nx = 1\ny = 2\nbye for now") == "x = 1\ny = 2"


def test_tool_call_score():
    a = [{"name": "f", "parameters": {"x": 1}}]
    assert tx.tool_call_score(a, a) == 3.0
    assert tx.tool_call_score(a, []) == -3.0


def quadratic_code(text):
    """Every run of two lines or more, in order; a longer count of lines that are not blank wins."""
    lines = text.split("\n")
    best, kept = 0, (0, 0)
    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            count = sum(bool(x.strip()) for x in lines[i : j + 1])
            if count > best:
                try:
                    ast.parse("\n".join(lines[i : j + 1]))
                except (SyntaxError, ValueError):
                    continue
                best, kept = count, (i, j)
    return "\n".join(lines[kept[0] : kept[1] + 1])


def test_longest_code_is_that_of_every_run():
    pieces = ["x = 1", "", "  ", "y = (2,", ")", "if x:", "    z = 3", "else:", "some words here", "def f(a):", "    return a", "try:", "except E:", "    pass", "s = \"\"\"", "t = x \\", "d = {", "1: 2,", "}", "@deco", "g(a b", "# note", "\tq = 1", "f(x for x in y, 1)", "class A: pass", "x = [1,", "2 3]", "\x0c"]
    rng = random.Random(3)
    cases = ["x = 1\n\n\n\ny = 2\n??? no\na = 1\nb = 2\nc = 3", "", "one line", "\nx = 1", "bad text\n\nx = 1\nbad text", "x = 1 \\\n\n\nno no"]
    cases += ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for case in cases:
        assert tx.longest_code(case) == quadratic_code(case), case


def test_latex_marks():
    assert not tx.latex_equal("50%", "50") and tx.latex_equal("50\\%", "50") and tx.latex_equal("x = .5", "\\frac12")
    assert tx.latex_plain("\\sqrt3") == "\\sqrt{3}" and tx.latex_plain("\\sqrt 3") == "\\sqrt{}3" and tx.latex_plain("\\frac1{72}") == "\\frac{1}{72}" and tx.latex_plain("\\frac1") == "\\frac1"
    assert tx.latex_plain("01/2") == "01/2" and tx.latex_plain("-1/2") == "\\frac{-1}{2}" and tx.latex_plain("3\\text{ cm}") == "3"
    assert not tx.latex_equal("\\sqrt", "\\sqrt ") and tx.latex_equal("\\frac", "\\frac") and tx.latex_equal("", "")
    assert tx.final_answer("y = the $\\text{1,000}$ dollars") == "1000" and tx.final_answer("\\fracab") == "\\frac{a}{b}" and tx.final_answer("x=\\sqrt2") == "\\sqrt{2}"


def test_tool_formats(spark):
    full = "<|tool_calls_section_begin|>"
    cases = {
        "hermes": 'a<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>b<tool_call>broken</tool_call>',
        "qwen3_coder": "a<tool_call><function=f><parameter=x>\n1\n</parameter></function></tool_call>b",
        "glm": "<think>no</think>a<tool_call>f<arg_key>x</arg_key><arg_value>1</arg_value></tool_call>b",
        "seed": "a<seed:tool_call><function=f><parameter=x>1</parameter></function></seed:tool_call>",
        "minimax": 'a<minimax:tool_call><invoke name="f"><parameter name="x">1</parameter></invoke></minimax:tool_call>',
        "gpt-oss": '<|channel|>analysis<|message|><|start|>assistant<|channel|>c to=functions.no <|constrain|>json<|message|>{}<|call|><|end|>a<|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{"x": 1}<|call|>',
        "kimi": f'a{full}<|tool_call_begin|>functions.f:0<|tool_call_argument_begin|>{{"x": 1}}<|tool_call_end|>',
        "gemma4": "a<|tool_call>call:f{x:1}<tool_call|>",
    }
    schemas = {"f": {"properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    for name, text in cases.items():
        df = spark.createDataFrame([(text,), ("plain",), (None,), ("",)], "t string")
        got = [r["c"] for r in df.select(tools.parsed(name, F.col("t"), schemas).alias("c")).collect()]
        assert [(c["name"], json.loads(c["arguments"])) for c in got[0]["calls"]] == [("f", {"x": 1})], name
        assert got[0]["content"] == ("ab<tool_call>broken</tool_call>".replace("<tool_call>broken</tool_call>", "") if name == "hermes" else "a"), name
        assert (got[1]["content"], got[1]["calls"]) == ("plain", []) and got[2] is None and (got[3]["content"], got[3]["calls"]) == ("", [])
    assert tools.extract(cases["minimax"].replace("minimax:", ""), tools.FORMATS["minimax"])[1] == []


def test_tool_arguments_by_schema():
    kinds = [("7", "int32", 7), ("x", "integer", "x"), ("2.0", "number", 2), ("2.5", "float", 2.5), ("TRUE", "boolean", True), ("no", "bool", False), ("NULL", "integer", None), ('{"a": 1}', "object", {"a": 1}), ("[1, 'b']", "array", [1, "b"]), ("f(x)", "array", "f(x)"), ("1", "string", "1"), ("1", None, "1"), ("1e400", "number", "1e400"), ("{'a': 1}", "dict", {"a": 1})]
    for value, kind, want in kinds:
        assert tools.by_schema(value, kind) == want and type(tools.by_schema(value, kind)) is type(want), (value, kind)
    coder = tools.FORMATS["qwen3_coder"]
    assert tools.extract("a<tool_call><function=f><parameter=x>1", coder, {"f": {"properties": {"x": {"type": "int"}}}}) == ("a", [("f", '{"x": 1}', "")])
    assert tools.extract("a<tool_call><function=f</function></tool_call>", coder) == ("a", []) and tools.extract("a<tool_call>b", coder) == ("a<tool_call>b", [])
    kimi = lambda raw, args, schemas: tools.extract(f"<|tool_calls_section_begin|><|tool_call_begin|>{raw}<|tool_call_argument_begin|>{args}<|tool_call_end|>", tools.FORMATS["kimi"], schemas)[1][0]
    both = {"get_weather": {"required": ["city"]}, "search": {"required": ["q"]}}
    assert kimi("functions.get-weather:0", "{}", both)[0] == "get_weather" and kimi("t:1", '{"q": 1}', both) == ("search", '{"q": 1}', "t:1") and kimi("t:1", "[]", both) == ("t:1", "{}", "t:1")
    assert tools.extract('<|tool_call>call:f{a:<|"|>x, y<|"|>,b:True,c:null,d:1.5,e:word}<tool_call|>', tools.FORMATS["gemma4"])[1] == [("f", '{"a": "x, y", "b": true, "c": null, "d": 1.5, "e": "word"}', "")]
    with pytest.raises(ValueError, match="registered"):
        tools.register("hermes", coder)


def test_plan_grammar_takes_every_event(spark, sf):
    from braidwork.plans import catalogue

    events = spark.read.parquet(f"{sf}/events.parquet")
    want = events.groupBy("user_id").agg(F.count("*").alias("steps"), F.max("event_id").alias("last"))
    got = catalogue.queries()["X23_plan_grammar"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_plan_grammar_single_and_parallel(spark):
    text = "intro\n    - call lost({})\nStep 1: call f({\"x\": \"(1)\"})\n\nStep 2 (parallel):\n    - call g({'y': 2})\nnote\n    - call h.i(raw's)  \nStep 9: f(1)\nStep 9: call k({})"
    df = spark.createDataFrame([(text,), ("plain",), ("",), (None,)], "t string")
    got = [r["p"] for r in df.select(tools.parse_plan(F.col("t")).alias("p")).collect()]
    want = [(1, "f", '{"x": "(1)"}'), (2, "g", '{"y": 2}'), (2, "h.i", "raw's"), (4, "k", "{}")]
    assert [tuple(c) for c in got[0]] == want and got[1:] == [[], [], None]
    steps = [[("f", '{"x": 1}')], [], [("g", "{}"), ("h", "{}")]]
    plan = spark.createDataFrame([(steps,)], "s array<array<struct<name: string, arguments: string>>>").select(tools.render_plan(F.col("s"))).first()[0]
    assert plan == 'Step 1: call f({"x": 1})\nStep 2 (parallel):\n    - call g({})\n    - call h({})'


def test_final_answer_comparison():
    assert tx.minerva("Answer: 3\nanswer : x = 1,000 dollars\nend", "1000") == (True, "1000")
    assert tx.minerva("1000", "1000") == (False, "[INVALID]")
    assert tx.minerva("Answer: \\frac12", "so \\boxed{\\frac{1}{2}}", True)[0] and not tx.minerva("Answer: 1", "1", True)[0]
    assert tx.strict_box("\\boxed{1} \\boxed{\\frac{1}{2}}.", "\\frac{1}{2}") == (1, "\\frac{1}{2}")
    assert tx.strict_box("\\boxed{1}" + "." * 100, "1") == (-1, None) and tx.strict_box("\\boxed{1", "1") == (-1, None)
    assert tx.strict_box("\\boxed{1}" + "." * 200, "1", [0, 0, 0, 100]) == (1, "1")
    assert tx.strict_box("\\boxed{a \\boxed b$}", "a \\boxed b$") == (1, "a \\boxed b$")


def test_weight_map():
    both = {"Action:": [2, 3], "Result:": [0, 1], "x": [9]}
    assert tx.weight_map("q", "x Action:aResult:", both) == [("x ", 1.0), ("Action:", 2.0), ("a", 3.0), ("Result:", 0.0), ("", 1.0)]
    assert tx.weight_map("a query", "Action:a", both, {"none": [5], "query": [0.5]}) == [("Action:a", 0.5)]
    assert tx.weight_map(None, "a<b>c", {"<.*?>": [2]}) == [("a", 1.0), ("<b>", 2.0), ("c", 1.0)]
    assert tx.weight_map("", "", both) == [] and tx.weight_map("", "plain", {}) == [("plain", 1.0)]


def test_path_columns_take_every_language(spark, tmp_path):
    from braidwork.plans import catalogue

    langs = ["en", "en", "pt", "a/b c", "", None]
    spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["P30_path_columns"](spark, str(tmp_path)).collect()
    assert {r["model"]: r["n"] for r in got} == {"en": 2, "pt": 1, "a/b c": 1, "": 1, None: 1}


def test_rename_collision(spark):
    df = spark.createDataFrame([(1, 2)], "Answer int, output int")
    assert messages.alias_columns(df).columns == ["Answer", "output"]


def test_resolve_reward(spark):
    df = spark.createDataFrame([([1.0, None], 1.0)], "t array<double>, v double")
    assert df.select(rubrics.resolve_reward(F.col("t"), F.col("v")).alias("r")).first()["r"] == 1.0
    with pytest.raises(Exception, match="differ"):
        df.select(rubrics.resolve_reward(F.col("t"), F.lit(3.0))).collect()


def test_truthy(spark):
    df = spark.createDataFrame([("True",), (" yes",), ("0",), ("?",), (None,)], "s string")
    assert [r["b"] for r in df.select(metrics.truthy(F.col("s")).alias("b")).collect()] == [True, True, False, None, None]


def test_cosine_top_k_blocks_agree(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11) - 5 for j in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = retrieval.cosine_top_k(df, df.filter("vec_id < 5"), 4, -1.0)
    many = retrieval.compare_all(df, df.filter("vec_id < 5"), 4, -1.0, block=7, query_block=2)
    assert sorted(map(tuple, one.select("query_id", "id", "rank").collect())) == sorted(map(tuple, many.select("query_id", "id", "rank").collect()))


def test_buffer(spark):
    assert buffer.refill_plan(4, 6, [3, 3, 3]) == [(0, 4, 1), (1, 2, 0), (2, 0, 0)]
    log = spark.createDataFrame([("a", 0, 1, 3, "running"), ("a", 0, 2, 3, "finished"), ("b", 0, 3, 4, "running")], "uid string, member int, line int, step int, status string")
    status = buffer.latest_status(log, ["uid", "member"], "status", "line")
    assert [r["uid"] for r in buffer.sampleable(status, "uid").collect()] == ["a"]
    assert buffer.must_wait(status, 10, 7).first()["wait"] and not buffer.must_wait(status, 10, 8).first()["wait"]


def test_map_rows_drops_or_raises(spark):
    def f(row):
        if row["id"] == 1:
            raise ValueError("no")
        return {"id": row["id"]}

    assert extend.map_rows(spark.range(3), f, "id long").count() == 2
    with pytest.raises(Exception, match="no"):
        extend.map_rows(spark.range(3), f, "id long", strict=True).collect()


def test_tolerant_jsonl(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{bad\n{"k": 2}\n')
    rows, counts = files.tolerant_jsonl(spark, f"file://{tmp_path}/a.jsonl", T.StructType([T.StructField("k", T.LongType())]))
    assert sorted(r["k"] for r in rows.collect()) == [1, 2] and tuple(counts.first()) == (2, 1)


def test_keyword_top_k_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b"), (2, "B c"), (3, ""), (4, None), (5, "a a a a")], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "A b"), (2, "zzz"), (3, None), (4, "c a")], "item_id long, text string")
    scan = retrieval.keyword_top_k(docs, questions, "doc_id", "text", "item_id", "text", 2)
    want = sorted((r["question"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in scan.collect())
    assert want == [(1, 1, 1.0, 1), (1, 5, 1.0, 2), (4, 2, 0.5, 2), (4, 5, 1.0, 1)]
    monkeypatch.setattr(retrieval, "MAX_QUESTIONS", 1)
    join = retrieval.keyword_top_k(docs, questions, "doc_id", "text", "item_id", "text", 2)
    assert sorted((r["question"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in join.collect()) == want


def test_keyword_top_k_of_repeated_ids_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (1, "a"), (2, "a"), (3, "a d"), (4, "b b"), (None, "a b")], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b c")], "item_id long, text string")

    def ranked():
        out = retrieval.keyword_top_k(docs.repartition(3), questions, "doc_id", "text", "item_id", "text", 2)
        return sorted((r["question"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in out.collect())

    want = [(1, 1, 2.0, 1), (1, 2, 1.0, 2), (2, 1, 1.0, 1), (2, 4, 1.0, 2)]
    assert ranked() == want
    monkeypatch.setattr(retrieval, "MAX_QUESTIONS", 1)
    assert ranked() == want


def test_encoded_payloads():
    import base64
    import pickle
    import zlib

    from braidwork.functions import payloads

    pack = lambda x, protocol=4: base64.b64encode(zlib.compress(pickle.dumps(x, protocol))).decode()
    for protocol in range(6):
        assert payloads.decode_tests(pack('[{"a": "é"}]', protocol)) == [{"a": "é"}]
    assert payloads.decode_tests("[1]") == [1] and payloads.decode_tests(pack(b"[2]", 4)) == [2]
    for bad in (pack(["[1]"]), pack(print), pack("{}"), "{}", "no", "aGVsbG8=", pack(7)):
        with pytest.raises(ValueError):
            payloads.decode_tests(bad)


def test_overlaps_of_words():
    from braidwork.functions import payloads

    a, b = "the cat sat on the mat".split(), "the cat is on the mat".split()
    got = payloads.overlaps(a, b)
    assert got["rouge_1"] == pytest.approx(5 / 6) and got["rouge_2"] == pytest.approx(3 / 5) and got["rouge_l"] == pytest.approx(5 / 6)
    # precisions 5/6, 3/5, 1/4 and, smoothed, 1 / (2 * 3)
    assert got["bleu_4"] == pytest.approx((5 / 6 * 3 / 5 * 1 / 4 * 1 / 6) ** 0.25)
    assert payloads.overlaps(["x"], ["y"]) == {"rouge_1": 0.0, "rouge_2": 0.0, "rouge_l": 0.0, "bleu_4": 0.0} and payloads.overlaps([], ["y"]) is None
    assert payloads.bleu(["a"] * 4, ["a"] * 8) == pytest.approx(math.exp(-1)) and payloads.bleu(a, a) == pytest.approx(1.0)
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        brute = max((len(s) for n in range(len(x) + 1) for s in itertools.combinations(x, n) if all(w in it for it in [iter(y)] for w in s)), default=0)
        assert payloads.common_subsequence(x, y) == brute


def test_metric_weights(spark):
    rows = [
        (1, "actor/pg_loss/mean", 1.0, 1), (2, "actor/pg_loss/mean", 3.0, 3), (1, "actor/kl", 2.0, 1), (2, "actor/kl", 4.0, 3), (1, "grad/max", 1.0, 1), (2, "grad/max", 5.0, 1), (3, "grad/max", 3.0, 1),
        (1, "timing_s/update_actor", 1.5, 1), (2, "timing_s/update_actor", 2.5, 1), (1, "some/total_tokens", 10.0, 1), (2, "some/total_tokens", 20.0, 1),
        (1, "training/off_policy/dropped_samples", 2.0, 9), (2, "training/off_policy/dropped_samples", 3.0, 9), (1, "training/global_step", 7.0, 1), (2, "training/global_step", 8.0, 1),
        (1, "validation/off_policy/dropped_samples", 1.0, 9), (2, "validation/off_policy/dropped_samples", 3.0, 9),
        (1, "validation/off_policy/dropped_samples_staleness/mean", 10.0, 9), (2, "validation/off_policy/dropped_samples_staleness/mean", 2.0, 9),
    ]
    df = metrics.staleness_weighted(spark.createDataFrame(rows, "step long, name string, value double, weight long"))
    got = {r["name"]: r["value"] for r in metrics.reduce_metrics(df, metrics.weighted_rule(F.col("name"))).collect()}
    assert got["actor/pg_loss/mean"] == 2.5 and got["actor/kl"] == 3.5 and got["grad/max"] == 5 and got["timing_s/update_actor"] == 4.0 and got["some/total_tokens"] == 30
    assert got["training/off_policy/dropped_samples"] == 5 and got["training/global_step"] == 8 and got["validation/off_policy/dropped_samples_staleness/mean"] == 4.0


def test_quantiles_and_ranks(spark):
    from braidwork.operators import quantiles

    rng = np.random.default_rng(2)
    for values in ([1.0], [2.0] * 50, rng.normal(size=999).tolist(), (rng.integers(0, 5, 400) * 1.0).tolist(), [0.0] * 900 + rng.normal(size=99).tolist()):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert quantiles.quantiles(df, "v", [0, 0.5, 0.95, 0.99, 1]) == pytest.approx(np.quantile(values, [0, 0.5, 0.95, 0.99, 1]).tolist())
        ranks = {r["v"]: r["r"] for r in quantiles.average_ranks(df, "v", "r").collect()}
        assert ranks == {v: (np.sum(np.array(values) < v) + (values.count(v) + 1) / 2) for v in set(values)}
    assert quantiles.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_packing_carries_the_last_bin():
    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 40))]
        packs = packing.batched(lengths, 50, 7)
        assert sorted(set(packs)) == list(range(len(set(packs))))
        for p in set(packs):
            own = [n for n, q in zip(lengths, packs) if q == p]
            assert sum(own) <= 50 or len(own) == 1
        # by hand: the last bin of a batch is packed anew with the next one
        held, want = [], []
        for begin in range(0, len(lengths), 7):
            held += list(range(begin, min(begin + 7, len(lengths))))
            bins = packing.best_fit([lengths[i] for i in held], 50)
            groups = [[i for i, b in zip(held, bins) if b == j] for j in range(max(bins) + 1)]
            held = [] if begin + 7 >= len(lengths) else sorted(groups.pop())
            want += groups
        assert [sorted(i for i, q in enumerate(packs) if q == p) for p in range(len(want))] == [sorted(g) for g in want]
    assert packing.batched([5, 5, 5], 10, 1, "sequential") == packing.next_fit([5, 5, 5], 10)
    assert packing.centre_out([5, 1, 9, 3]) == [2, 3, 1, 0]
    assert packing.micro_count(10, 100, 30, 4) == 4 and packing.micro_count(3, 100, 1) == 3 and packing.micro_count(0, 0, 5) == 1
    with pytest.raises(ValueError):
        packing.balanced([1, 2, 3], 2, True)


def test_select_tasks(spark):
    from braidwork.operators import filters

    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "n long, id string")
    ids = lambda **a: [r["id"] for r in filters.select_tasks(df, "id", "n", **a).orderBy("n").collect()]
    assert ids(places="0-2, 5") == ["t0", "t1", "t2", "t5"] and ids(ids=["t3", "t1"]) == ["t1", "t3"] and ids(places="4-9", most=2) == ["t4", "t5"]
    assert ids(places="0-5", ids=["t5", "t9"]) == ["t5"] and ids(ids=["t1", "x"], unknown="ignore") == ["t1"]
    for wrong in ({"places": "3-1"}, {"places": "10"}, {"places": "a"}, {"ids": ["x"]}, {"most": 0}, {"places": "0", "ids": ["t1"]}):
        with pytest.raises(ValueError):
            ids(**wrong)
    with pytest.raises(ValueError, match="repeated"):
        filters.select_tasks(df.union(df), "id", "n")


def test_interleave_loses_no_row(spark):
    a, b = spark.range(10), spark.range(100, 102)
    rows = sampling.interleave([(a, 0.9997), (b, 0.0003)], "id", until="all").collect()
    assert {r["id"] for r in rows} == {*range(10), 100, 101} and sorted(r["slot"] for r in rows) == list(range(len(rows)))
    with pytest.raises(ValueError):
        sampling.interleave([(a, 1 - 1e-9), (b, 1e-9)], "id", until="all")


def test_media_and_labels(spark):
    df = spark.createDataFrame([("a <image> b", ["p"])], "t string, m array<string>")
    seg = messages.media_segments(F.array(messages.message("user", F.col("t"))), {"image": F.col("m")})
    assert [tuple(x) for x in df.select(F.flatten(seg).alias("s")).first()["s"]] == [("text", "a "), ("image", "p"), ("text", " b")]
    with pytest.raises(Exception, match="differ in number"):
        df.select(messages.media_segments(F.array(messages.message("user", F.col("t"))), {"image": F.array()})).collect()
    labels = spark.createDataFrame([(0,), (1,), (None,)], "l int")
    assert [r["response"] for r in messages.label_text(labels, "l", ["no", "yes"]).collect()] == ["no", "yes"]
    with pytest.raises(Exception, match="no name for label"):
        messages.label_text(labels, "l", ["no"]).collect()
    assert messages.split_text("aab", ["ab", "aab"]) == [("aab", "")]
    assert messages.split_text("x<1>y", ["<.>"], True) == [("", "x"), ("<.>", "<1>"), ("", "y")] and messages.split_text("", ["a"]) == []


def test_rubric_hooks_and_registries(spark):
    from braidwork.functions import extend

    inner = rubrics.Rubric("inner", lambda a, o: o * 2)
    seen = []
    outer = rubrics.Rubric("outer", children=[(inner, 1.0)]).before(lambda r, a, o: seen.append("before")).after(lambda r, a, o, s: s + 1)
    row = outer.scored(spark.range(1), F.lit("x"), F.lit(3.0)).first()
    assert row["outer"] == 7.0 and row["outer/inner"] == 6.0 and seen == ["before"]
    with pytest.raises(ValueError):
        rubrics.Rubric("both")
    registry = extend.Registry("thing")
    registry.register("a", len)
    with pytest.raises(ValueError, match="already"):
        registry.register("a", len)
    with pytest.raises(ValueError, match="no thing b"):
        registry.get("b")
    with pytest.raises(Exception, match="no scorer for z"):
        spark.range(1).select(extend.dispatched(F.lit("z"), {"a": F.lit(1.0)})).collect()


def test_stream_bins_are_those_of_the_table(spark, sf):
    from braidwork.plans import catalogue

    got = catalogue.queries()["B04_stream_bins"](spark, sf).collect()
    docs = sorted((r["doc_id"], r["n_chars"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars").collect())
    want = set()
    for shard in range(4):
        own = [d for d in docs if d[0] % 4 == shard]
        want |= {(shard, i, n, p) for (i, n), p in zip(own, packing.batched([n for _, n in own], 40_000, 32))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_cyclic_packs():
    packs = packing.cyclic([3, 4, 5], 8, 20, 4)
    assert len(packs) == 20 and all(sum([3, 4, 5][i] for i in p) <= 8 for p in packs) and packing.cyclic([], 8, 3) == []
    flat = [i for p in packing.cyclic([3, 4, 5], 8, 1000, 4) for i in p]
    assert abs(flat.count(0) - flat.count(1)) <= 3


@pytest.mark.parametrize("lengths", [[0, 150, 10], [0, 0, 100, 0, 150, 0, 60, 40, 0, 1], [150, 0, 0, 99, 1, 0], [30, 80, 20, 0, 100, 100, 0]])
def test_stream_packs_are_those_of_the_table(spark, lengths):
    from braidwork.streaming import buffer, run

    rows = [(0, i, n) for i, n in enumerate(lengths)]
    parts = [spark.createDataFrame(part, "shard long, i long, n long") for part in (rows[:1], rows[1:4], rows[4:]) if part]
    got = run.run_increments(parts, lambda s: buffer.pack_stream(s, "shard", "i", "n", 100)).collect()
    assert [r["pack"] for r in sorted(got, key=lambda r: r["ordinal"])] == packing.next_fit(lengths, 100)


def test_cyclic_packs_of_a_table(spark):
    lengths = {0: [3, 4, 5], 1: [9, 0, 2, 2, 7]}
    df = spark.createDataFrame([(s, i * 10, n) for s, own in lengths.items() for i, n in enumerate(own)], "s long, i long, n long")
    got = packing.cyclic_packs(df, F.col("s"), "i", "n", 9, 12, 4).collect()
    for s, own in lengths.items():
        packs = [[r["ordinal"] // 10 for r in sorted(got, key=lambda r: r["slot"]) if (r["shard"], r["pack"]) == (s, p)] for p in range(12)]
        assert packs == packing.cyclic(own, 9, 12, 4)
    assert packing.cyclic_packs(df.limit(0), F.col("s"), "i", "n", 9, 12).count() == 0


def test_uid_partitions_of_any_number_of_groups(spark):
    assert [packing.least_divisor(n) for n in (1, 2, 3, 4, 9, 15, 35, 37)] == [1, 2, 3, 2, 3, 3, 5, 37]
    rows = [(b, u, u * 10 + i, (u * 7 + i) % 50) for b, n in enumerate((1, 4, 9, 7)) for u in range(n) for i in range(3)]
    df = spark.createDataFrame(rows, "b long, u long, o long, n long")
    parts = packing.uid_partitions(df, F.col("b"), "u", "o", "n", packing.least_divisor).collect()
    for b, n in enumerate((1, 4, 9, 7)):
        own = [r for r in parts if r["shard"] == b]
        sizes = [sum(r["part"] == p for r in own) for p in range(packing.least_divisor(n))]
        assert sorted(r["uid"] for r in own) == list(range(n)) and len(set(sizes)) == 1 and sizes[0] > 0
    with pytest.raises(Exception, match="multiple"):
        packing.uid_partitions(df, F.col("b"), "u", "o", "n", 2).collect()


def test_micro_batches_stand_centre_out(spark):
    lengths = [50, 40, 30, 20, 10, 5, 5, 1]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "g long, i long, n long")
    got = packing.micro_batches(df, "g", "i", "n", 35).collect()
    loads = [sum(24576 * r["value"] + r["value"] ** 2 for r in got if r["micro"] == m) for m in range(5)]
    assert len({r["micro"] for r in got}) == 5 and max(loads) == loads[2] and loads[0] < loads[1] < loads[2] > loads[3] > loads[4]


def test_vector_index(spark):
    """Clustered vectors: exact search gives what comparing all rows gives, with fewer lists; probing alone finds nine of ten."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(30, 16))
    rows = [(i, "ab"[i % 2], (centre[i % 30] + 0.25 * rng.normal(size=16)).astype(float).tolist()) for i in range(1500)]
    rows += [(2000 + i, "a", [0.0] * 16) for i in range(3)] + [(3000, "b", None)] + [(4000 + i, "a", rows[0][2]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, t string, embedding array<double>")
    asked = df.filter("vec_id % 50 = 0 and embedding is not null")
    key = lambda r: (r["query_id"], r["id"], r["rank"], round(r["similarity"], 9))
    for k, least in ((7, 0.2), (60, 0.97), (1, -1.0)):
        index = retrieval.vector_index(df, cells=30, block=16)
        want = retrieval.compare_all(df.filter("embedding is not null"), asked, k, least)
        assert sorted(map(key, retrieval.index_top_k(index, asked, k, least, probes=2, query_block=3).collect())) == sorted(map(key, want.collect()))
    found = retrieval.recall(retrieval.index_top_k(index, asked, 10, -1.0, probes=3, exact=False), retrieval.compare_all(df.filter("embedding is not null"), asked, 10, -1.0))
    r = found.agg((F.sum("hit") / F.sum("wanted")).alias("r")).first()["r"]
    assert 0.9 <= r <= 1
    tiered = retrieval.vector_index(df, tier="t")
    want = retrieval.compare_all(df.filter("embedding is not null"), asked, 3, 0.1, tier="t")
    assert sorted((*key(r), r["t"]) for r in retrieval.index_top_k(tiered, asked, 3, 0.1).collect()) == sorted((*key(r), r["t"]) for r in want.collect())
    assert retrieval.cosine_top_k(df.limit(0), asked, 3, 0.1).count() == 0
    plan = retrieval.index_top_k(index, asked, 5, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner, (cell" in plan


def test_overlaps_of_periods_of_any_length(spark):
    """Minutes, hours and decades, before and after 1970, against every pair; a period takes rows of the logarithm of its length."""
    rng = random.Random(3)
    base, rows = 1_700_000_000, []
    for i in range(300):
        s = base + rng.randrange(-10**6, 10**6) if i % 9 else rng.choice([-10**9, 0, base - 3 * 10**8])
        rows.append((i, i % 3, s, s + rng.choice([0, 1, 60, 3599, 3600, 7200, 86_400, 10**6, 3 * 10**8, 8 * 10**8])))
    df = spark.createDataFrame(rows, "id long, g long, x long, y long").select("id", "g", F.timestamp_seconds("x").alias("s"), F.timestamp_seconds("y").alias("e"))
    a, b = df.filter("id % 2 = 0"), df.filter("id % 2 = 1 or id % 10 = 0")
    for on in ((), ("g",)):
        got = relational.overlap_join(a, b, "s", "e", 3600, on).select("id", "b_id").collect()
        want = {(p[0], q[0]) for p in rows for q in rows if p[0] % 2 == 0 and (q[0] % 2 or q[0] % 10 == 0) and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3] and (not on or p[1] == q[1])}
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    cover = spark.createDataFrame([(5, 6), (-7, 9), (0, 210_384), (1, 2**40 - 1)], "f long, u long").select("f", "u", relational.dyadic_cover("f", "u", 41).alias("c")).collect()
    for r in cover:
        slots = sorted((x["number"] << x["level"], (x["number"] + 1) << x["level"]) for x in r["c"])
        assert slots[0][0] == r["f"] and slots[-1][1] == r["u"] and all(p[1] == q[0] for p, q in zip(slots, slots[1:]))
        assert len(slots) <= 2 * (r["u"] - r["f"]).bit_length()


def test_ranges_are_even_whatever_labels_begin_with(spark):
    df = spark.range(60_000).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("x"))
    sizes = [r["count"] for r in sampling.ranged(df, ["x"], "b", 5000).groupBy("b").count().collect()]
    assert sum(sizes) == 60_000 and len(sizes) >= 10 and max(sizes) < 15_000
    got = sampling.ordinals(df.filter("x < 'user_3'"), ["x"], "o", rows_per_range=2000).collect()
    assert [r["x"] for r in sorted(got, key=lambda r: r["o"])] == sorted(r["x"] for r in got) and {r["o"] for r in got} == set(range(len(got)))


def test_value_counts_in_many_ranges(spark):
    from braidwork.operators import quantiles

    values = [(i * 7919) % 1000 / 8 for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r["v"]: (r["n"], r["before"]) for r in quantiles.value_counts(df, "v", 64).collect()}
    assert got == {v: (values.count(v), sum(x < v for x in values)) for v in set(values)}
