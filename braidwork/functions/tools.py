"""Tool-call markup and plan grammar.

A text has some calls in the markup of a model family, and content besides. `extract` reads one text; `parser` makes a Spark function of
it that gives struct<content, calls array<struct<name, arguments, id>>>, arguments as JSON text. Formats are data: what marks calls,
where a name and its arguments stand, and how values are read.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARSED = "struct<content: string, calls: array<struct<name: string, arguments: string, id: string>>>"


@dataclass(frozen=True)
class Format:
    marks: tuple[str, ...]  # all must be in a text that has calls; the first opens them
    call: str  # pattern of a call: its groups that match are name and arguments, or one with both
    outer: str = ""  # pattern of what surrounds calls; its first group that matched is searched for calls
    pair: str = ""  # pattern of an argument within the arguments: key and value; without, they are JSON
    values: str = "json"  # how a value is read: json, schema, or bare
    before: bool = True  # content is what stands before the first mark; else what is left without calls
    hidden: tuple[str, ...] = ()  # patterns that go before anything else
    from_content: tuple[str, ...] = ()  # patterns that go from the content


#: The markup of each model family.
FORMATS: dict[str, Format] = {
    "hermes": Format(("<tool_call>", "</tool_call>"), r"<tool_call>(.*?)</tool_call>", before=False),
    "gpt-oss": Format(
        ("<|channel|>",),
        r"<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>",
        values="raw",
        before=False,
        hidden=(r"<\|start\|>assistant<\|channel\|>analysis<\|message\|>.*?<\|end\|>", r"<\|channel\|>analysis<\|message\|>.*?<\|end\|>"),
    ),
    "qwen3_coder": Format(
        ("<tool_call>",),
        r"<function=(?:(.*?)</function>|(.*)$)",
        outer=r"<tool_call>(?:(.*?)</tool_call>|(.*?)$)",
        pair=r"<parameter=(?:(.*?)</parameter>|(.*?)$)",
        values="schema",
    ),
    "glm": Format(
        ("<tool_call>", "</tool_call>"),
        r"<tool_call>(.*?)(?=<arg_key>|</tool_call>)(.*?)</tool_call>",
        pair=r"<arg_key>(.*?)</arg_key>\s*<arg_value>(.*?)</arg_value>",
        from_content=(r"^\s*<think>.*?</think>", r"^\s*</think>"),
    ),
    "seed": Format(
        ("<seed:tool_call>", "</seed:tool_call>"),
        r"<function=([^>\n]+)>\s*(.*?)</function>",
        outer=r"<seed:tool_call>(.*?)</seed:tool_call>",
        pair=r"<parameter=([^>\n]+)>(.*?)</parameter>",
    ),
    "minimax": Format(
        ("<minimax:tool_call>", "</minimax:tool_call>"),
        r'<invoke name="([^"]+)">\s*(.*?)</invoke>',
        outer=r"<minimax:tool_call>(.*?)</minimax:tool_call>",
        pair=r'<parameter name="([^"]+)">(.*?)</parameter>',
    ),
    "kimi": Format(("<|tool_calls_section_begin|>",), r"<\|tool_call_begin\|>(.*?)<\|tool_call_argument_begin\|>(.*?)<\|tool_call_end\|>", values="object"),
    "gemma4": Format(("<|tool_call>",), r"<\|tool_call>call:(\w+)\{(.*?)\}<tool_call\|>", pair=r'(\w+):(?:<\|"\|>(.*?)<\|"\|>|([^,}]*))', values="bare"),
}
#: Types of a schema by their names or the beginnings of these.
TEXTS, WHOLE, REAL, TRUTH = ("string", "str", "text", "varchar", "char", "enum"), ("int", "uint", "long", "short", "unsigned"), ("num", "float"), ("boolean", "bool", "binary")


def _json_or_text(value: str):
    try:
        return json.loads(value.strip())
    except ValueError:
        return value.strip()


def _bare(text: str):
    """A value without quotes: true, false, null, a number, else the text."""
    text = text.strip()
    words = {"true": True, "false": False, "null": None}
    if text.lower() in words:
        return words[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def by_schema(value: str, kind: str | None):
    """A value as its declared type says; what does not read as that type stays text, a truth value becomes false. No type: text."""
    if value.lower() == "null":
        return None
    kind = (kind or "string").strip().lower()
    if kind in TEXTS:
        return value
    if kind in TRUTH:
        return value.lower() == "true"
    try:
        if kind.startswith(WHOLE):
            return int(value)
        if kind.startswith(REAL):
            number = float(value)
            return int(number) if number == int(number) else number
        if kind == "object" or kind.startswith("dict"):
            try:
                return json.loads(value)
            except ValueError:
                pass
        return ast.literal_eval(value)
    except (ValueError, SyntaxError, TypeError, OverflowError, MemoryError, RecursionError):
        return value


def _one_newline(text: str) -> str:
    return text.removeprefix("\n").removesuffix("\n")


def _inferred(name: str, arguments: dict, schemas: dict[str, dict]) -> str:
    """The tool meant by a name that is none: the only one whose name it contains, else the only one whose required arguments are there."""
    if name in schemas:
        return name
    flat = name.lower().replace("-", "_")
    for fit in ([n for n in schemas if n.lower() in flat], [n for n, s in schemas.items() if s.get("required") and set(s["required"]) <= set(arguments)]):
        if len(fit) == 1:
            return fit[0]
    return name


def _read(form: Format, groups: list[str], schemas: dict[str, dict]) -> tuple[str, str, str] | None:
    """Name, arguments as JSON and id of a call from its groups; None where it cannot be read."""
    if form.values == "schema":
        name, mark, body = groups[0].partition(">")
        if not mark:
            return None
        kinds, arguments = schemas.get(name, {}).get("properties", {}), {}
        for m in re.finditer(form.pair, body, re.S):
            key, mark, value = (m[1] or m[2] or "").partition(">")
            if mark:
                arguments[key] = by_schema(_one_newline(value), (kinds.get(key) or {}).get("type"))
        return name, json.dumps(arguments, ensure_ascii=False), ""
    if len(groups) == 1:
        try:
            call = json.loads(groups[0])
            return call["name"], json.dumps(call["arguments"], ensure_ascii=False), ""
        except (ValueError, KeyError, TypeError):
            return None
    name, body = groups
    if form.values == "raw":
        return name, body, ""
    if form.values == "object":
        found = _json_or_text(body)
        found = found if isinstance(found, dict) else {}
        return _inferred(name.strip(), found, schemas), json.dumps(found, ensure_ascii=False), name.strip()
    arguments = {}
    for m in re.finditer(form.pair, body, re.S):
        key, value = [g for g in m.groups() if g is not None]
        if form.values == "bare":
            arguments[key] = value if m[2] is not None else _bare(value)
        else:
            arguments[key.strip()] = _json_or_text(value)
    return name.strip(), json.dumps(arguments, ensure_ascii=False), ""


def extract(text: str, form: Format, schemas: dict[str, dict] | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """Content and calls (name, arguments, id) of a text. schemas: by tool, its JSON schema of parameters (`properties`, `required`)."""
    for pattern in form.hidden:
        text = re.sub(pattern, "", text, flags=re.S)
    if not all(m in text for m in form.marks):
        return text, []
    inside = [next(g for g in m.groups() if g is not None) for m in re.finditer(form.outer, text, re.S)] if form.outer else [text]
    found = [[g for g in m.groups() if g is not None] for part in inside for m in re.finditer(form.call, part, re.S)]
    if not found and (form.values in ("schema", "bare", "raw")):
        return text, []
    calls = [c for groups in found if (c := _read(form, groups, schemas or {})) is not None]
    content = text[: text.index(form.marks[0])] if form.before else re.sub(form.call, "", text, flags=re.S)
    for pattern in form.from_content:
        content = re.sub(pattern, "", content, flags=re.S)
    return content, calls


def parser(form: Format, schemas: dict[str, dict] | None = None) -> Callable[[Column], Column]:
    """A function from a text column to PARSED; null texts give null."""

    @F.pandas_udf(PARSED)
    def parse(text: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else extract(t, form, schemas) for t in text]
        calls = [None if c is None else [{"name": n, "arguments": a, "id": i or None} for n, a, i in c] for _, c in rows]
        return pd.DataFrame({"content": pd.Series([r[0] for r in rows], dtype="object"), "calls": pd.Series(calls, dtype="object")})

    return lambda text: F.when(text.isNotNull(), parse(text))


def register(name: str, form: Format) -> None:
    """Adds a format; a name can be taken once."""
    if name in FORMATS:
        raise ValueError(f"{name} is registered already")
    FORMATS[name] = form


def parsed(name: str, text: Column, schemas: dict[str, dict] | None = None) -> Column:
    """The text's content and calls in the format of that name."""
    if name not in FORMATS:
        raise ValueError(f"no tool-call format {name}")
    return parser(FORMATS[name], schemas)(text)


def render_plan(steps: Column) -> Column:
    """Plan of array<array<struct<name, arguments>>>: a step of one call is `Step k: call name(arguments)`, one of more is
    `Step k (parallel):` with a line `    - call name(arguments)` for each. Steps without calls are left out and not numbered."""

    def call(c: Column) -> Column:
        return F.concat(F.lit("call "), c["name"], F.lit("("), c["arguments"], F.lit(")"))

    def step(calls: Column, i: Column) -> Column:
        head = F.concat(F.lit("Step "), (i + 1).cast("string"))
        lines = F.array_join(F.transform(calls, lambda c: F.concat(F.lit("\n    - "), call(c))), "")
        return F.when(F.size(calls) == 1, F.concat(head, F.lit(": "), call(calls[0]))).otherwise(F.concat(head, F.lit(" (parallel):"), lines))

    return F.array_join(F.transform(F.filter(steps, lambda c: F.size(c) > 0), step), "\n")


def _lenient(arguments: Column) -> Column:
    """JSON text as it is, with ' read as \" where only that makes it JSON; other text stays."""
    quoted = F.replace(arguments, F.lit("'"), F.lit('"'))
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(~valid(arguments) & valid(quoted), quoted).otherwise(arguments)


def parse_plan(text: Column) -> Column:
    """array<struct<step, name, argument>>: the calls of a plan as render_plan writes it, single and parallel.

    A step is numbered by its place; a call outside any step and other lines are skipped.
    """
    lines = F.regexp_replace(text, "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    pattern = r"(?U)^(?:Step \d+(?: \(parallel\))?:|\s*-)\s*call\s+(.+?)\((.*)\)\s*$"
    # pieces begin at the heads of steps; the one before the first step is none
    steps = F.filter(F.split(lines, r"(?m)(?=^Step \d+(?: \(parallel\))?:)"), lambda x: x.rlike(r"^Step \d+(?: \(parallel\))?:"))

    def calls(piece: Column, i: Column) -> Column:
        def one(x: Column) -> Column:
            return F.struct((i + 1).cast("int").alias("step"), F.regexp_extract(x, pattern, 1).alias("name"), _lenient(F.regexp_extract(x, pattern, 2)).alias("argument"))

        return F.transform(F.filter(F.split(piece, "\n"), lambda x: x.rlike(pattern)), one)

    return F.flatten(F.transform(steps, calls))
