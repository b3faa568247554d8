"""Text normalising and answer scoring as Column expressions; Arrow UDFs only where nesting or types need Python."""

from __future__ import annotations

import ast
import json
import re
from collections import Counter
from fractions import Fraction
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def normalise_answer(text: Column) -> Column:
    """Lower case, punctuation deleted, articles and double spaces gone."""
    return _tidy(F.translate(F.lower(text), PUNCTUATION, ""))


def normalise_text(text: Column) -> Column:
    """As normalise_answer, but punctuation becomes a space."""
    return _tidy(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def exact_match(a: Column, b: Column) -> Column:
    return (normalise_text(a) == normalise_text(b)).cast("double")


def any_match(prediction: Column, golds: Column) -> Column:
    p = normalise_answer(prediction)
    return F.exists(golds, lambda g: normalise_answer(g) == p).cast("int")


def any_contained(prediction: Column, golds: Column) -> Column:
    p = normalise_answer(prediction)
    return F.exists(golds, lambda g: F.contains(p, normalise_answer(g))).cast("int")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Elements common to two arrays, counting repeats. Its work is the product of the sizes: for short arrays."""
    return F.aggregate(
        F.array_distinct(a),
        F.lit(0),
        lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))),
    )


def token_f1(a: Column, b: Column) -> Column:
    """F1 of word multisets; both empty is 1. Columns of normalised words."""
    both, n, m = word_overlap_udf(a, b), F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (n + m))


def list_similarity(a: Column, b: Column) -> Column:
    """Common elements over all, counting repeats; equal lists are 1, an empty one otherwise 0."""
    both = multiset_overlap(a, b)
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(both / n)


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"-?\d+\.?\d*", 0), F.lit("")).try_cast("double")


def numeric_accuracy(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """First numbers equal within the tolerance; without two numbers, exact match."""
    x, y = first_number(a), first_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), (F.abs(x - y) <= tolerance).cast("double")).otherwise(exact_match(a, b))


def choice_accuracy(a: Column, b: Column) -> Column:
    x, y = F.regexp_extract(a, r"\d+", 0), F.regexp_extract(b, r"\d+", 0)
    return F.when((x != "") & (y != ""), (x == y).cast("double")).otherwise(exact_match(a, b))


def contains_score(a: Column, b: Column) -> Column:
    x, y = normalise_text(a), normalise_text(b)
    return (F.contains(x, y) | F.contains(y, x)).cast("double")


def hash_answer(text: Column, flexible: bool = False) -> Column:
    """The last `#### number` of the last 300 characters, or flexibly the last number there; commas go in the strict form."""
    tail = F.right(text, F.lit(300))
    if flexible:
        found = F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), 1)
        some = F.filter(found, lambda x: ~x.isin("", "."))
        return F.coalesce(F.try_element_at(some, F.lit(-1)), F.try_element_at(found, F.lit(1)))
    found = F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)"), 1)
    return F.translate(F.try_element_at(found, F.lit(-1)), ",$", "")


def search_score(solution: Column, golds: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    """The last <answer> against any gold: 0 without one, a quarter of the score beyond ten tags."""
    found = F.regexp_extract_all(solution, F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    answer = F.trim(F.try_element_at(found, F.lit(-1)))
    tags = F.greatest(F.size(F.split(solution, "<answer>")), F.size(F.split(solution, "</answer>"))) - 1
    right = F.when(tags > 10, score / 4).otherwise(score)
    return F.when(answer.isNull(), 0.0).when(any_match(answer, golds) == 1, right).otherwise(format_score)


def format_reward(text: Column) -> Column:
    """1 where the text is a <think> part, then an <answer> part."""
    return text.rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>(?![\s\S])").cast("double")


def react_reward(text: Column) -> Column:
    """1 where the text has an action and its input, or a final answer."""
    return (text.rlike(r"(?s)Action:.*?Action Input:.*?$") | F.contains(text, F.lit("Final Answer:"))).cast("double")


def cosine_length_reward(correct: Column, length: Column, most: int, wrong: tuple[float, float] = (-0.5, 0.0), right: tuple[float, float] = (1.0, 0.5)) -> Column:
    """By a half cosine over the length: wrong answers go from wrong[0] to wrong[1], right ones from right[0] to right[1]."""

    def curve(low: float, high: float) -> Column:
        return high - (high - low) * (1 - F.cos(length * F.pi() / most)) / 2

    return F.when(correct, curve(right[1], right[0])).otherwise(curve(wrong[1], wrong[0]))


def repetition_penalty(text: Column, n: int, most: float) -> Column:
    """(1 - distinct / all n-grams of lower-cased words) * most; 0 for texts of fewer words."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) < n, 0.0).otherwise((1 - F.size(F.array_distinct(grams)) / F.size(grams)) * most)


def soft_overlong(length: Column, most: int, cache: int, factor: float = 1.0) -> Column:
    return F.least(-(length - (most - cache)) / cache * factor, F.lit(0.0))


def close(a: Column, b: Column, rel: float = 1e-6, absolute: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def unwrap_decimal(text: Column) -> Column:
    """The number in Decimal('...'), or of the text itself."""
    inner = F.regexp_extract(text, r"^Decimal\(['\"]?([^'\")]*)['\"]?\)$", 1)
    return F.when(inner != "", inner).otherwise(text).try_cast("double")


def code_block(text: Column) -> Column:
    """After the last </think>: the last fenced block, else the text."""
    rest = F.substring_index(text, "</think>", -1)
    blocks = F.regexp_extract_all(rest, F.lit(r"(?s)```(?:[A-Za-z0-9_+-]*)\n(.*?)```"), 1)
    return F.trim(F.coalesce(F.try_element_at(blocks, F.lit(-1)), rest), F.lit(" \n\r\t"))


def json_span(text: Column) -> Column:
    """From the first { to the last }; null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def repaired_json(text: Column) -> Column:
    """Fences and trailing commas go, bare keys get quotes, missing closing brackets are added."""
    t = F.trim(text)
    t = F.when(F.startswith(t, F.lit("```")), F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(t)
    t = F.regexp_replace(t, r",\s*([}\]])", "$1")
    t = F.regexp_replace(t, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_.-]*)(\s*:)", '$1"$2"$3')

    def open_(a: str, b: str) -> Column:
        count = lambda c: F.length(t) - F.length(F.translate(t, c, ""))
        return F.greatest(count(a) - count(b), F.lit(0))

    return F.concat(t, F.repeat(F.lit("}"), open_("{", "}")), F.repeat(F.lit("]"), open_("[", "]")))


# ---- Python where a regular expression can't do it

def boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{...} (or \\fbox), braces matched; `\\boxed x$` gives x."""
    if not text:
        return None
    if "\\boxed " in text:
        return text.rpartition("\\boxed ")[2].partition("$")[0]
    at = max(text.rfind("\\boxed{"), -1)
    at = at if at >= 0 else text.rfind("\\fbox{")
    if at < 0:
        return None
    return _braced(text, at)


def _braced(text: str, at: int) -> str | None:
    """Content of the first braces from `at` on; null if they are not closed."""
    depth, begin = 0, text.index("{", at)
    for i in range(begin, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[begin + 1 : i]
    return None


#: Fixed values of final-answer normalising: texts replaced, texts removed, then patterns replaced, in this order.
REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = ["square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots"]
UNWRAPPED = [(r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"), (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}"), (r"\$", "")]
_FINAL = [(re.compile(p), r) for p, r in [*((re.escape(a), b.replace("\\", r"\\")) for a, b in [*REPLACED, *((x, "") for x in REMOVED)]), *UNWRAPPED]]


def final_answer(text: str) -> str:
    """What follows the last =, by the table above; a number loses its commas."""
    answer = reduce(lambda t, step: step[0].sub(step[1], t), _FINAL, text.rpartition("=")[2])
    digits = answer.replace(",", "")
    return (digits if digits.isdigit() else answer).strip()


def last_box(text: str) -> str | None:
    """Content of the last \\boxed{...}, braces matched; null if there is none or it is not closed."""
    at = text.rfind("\\boxed{")
    return _braced(text, at) if at >= 0 else None


def minerva(solution: str, truth: str, extract: bool = False) -> tuple[bool, str]:
    """Whether the last `Answer: ..` line and the truth (extract: its last box) are equal when normalised, and the answer.

    A truth without a box to extract equals nothing.
    """
    found = re.findall(r"(?i)Answer\s*:\s*([^\n]+)", solution)
    answer = final_answer(found[-1] if found else "[INVALID]")
    truth = last_box(truth) if extract else truth
    return truth is not None and answer == final_answer(truth), answer


def strict_box(prediction: str, truth: str, pause: list[int] | None = None) -> tuple[int, str | None]:
    """1 or -1: whether the last box in the last 100 characters (from 100 before the last of four pause places) is the truth itself."""
    if pause is not None and len(pause) != 4:
        raise ValueError("four pause places are needed")
    box = last_box(prediction[pause[-1] - 100 :] if pause is not None else prediction[-100:])
    return (1 if box == truth else -1), box


def weight_map(query: str | None, response: str, response_map: dict[str, list[float]], query_map: dict[str, list[float]] | None = None) -> list[tuple[str, float]]:
    """Parts of a response and their loss weights, which rejoin to the response.

    The first key of query_map in the query weighs the whole response. Else keys of response_map with two weights are delimiters,
    weighed by the first, and what follows by the second; without such keys, those with one weight are regular expressions
    that weigh the parts they match. Anything else weighs 1.
    """
    for key, weight in (query_map or {}).items():
        if key in (query or ""):
            return [(response, float(weight[0] if isinstance(weight, list) else weight))]
    plain = [k for k, v in response_map.items() if len(v) == 2]
    keys = plain or [k for k, v in response_map.items() if len(v) == 1]
    found = list(re.finditer("|".join(f"(?:{re.escape(k) if plain else k})" for k in keys), response, re.DOTALL)) if keys else []
    ends = [m.start() for m in found[1:]] + [len(response)]
    parts = [("", response[: found[0].start()] if found else response)] + [(m[0], response[m.end() : e]) for m, e in zip(found, ends)]
    if plain:
        out = [(parts[0][1], 1.0)] if parts[0][1] else []
        return out + [x for k, c in parts[1:] for x in zip((k, c), map(float, response_map[k]))]
    own = lambda p: next((response_map[k][0] for k in keys if re.match(k, p, re.DOTALL)), 1.0)
    return [(p, float(own(p))) for pair in parts for p in pair if p]


#: Fixed values of LaTeX comparison: texts replaced before units go, and after.
LATEX_REPLACED = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
LATEX_AFTER_UNITS = [("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")]
UNITS = "\\text{ "


def _replaced(text: str, table: list[tuple[str, str]]) -> str:
    return reduce(lambda t, pair: t.replace(*pair), table, text)


def _braces_given(text: str, command: str, arguments: int) -> str:
    """Each of a command's single-character arguments in braces, where its first has none.

    A text where a command has nothing behind it can't be read (ValueError); one where an argument is missing stays as it is.
    """
    pieces = text.split(command)
    if any(not p for p in pieces[1:]):
        raise ValueError(f"nothing after {command}")
    bare = [not p.startswith("{") for p in pieces]
    if any(b and len(p) < arguments for b, p in zip(bare[1:], pieces[1:])):
        return text

    def given(piece: str) -> str:
        own, rest = piece[:arguments], piece[arguments:]
        return "".join(c if i and c == "{" else f"{{{c}}}" for i, c in enumerate(own)) + rest

    return command.join([pieces[0], *(given(p) if b else p for b, p in zip(bare[1:], pieces[1:]))])


def latex_plain(text: str) -> str:
    """A LaTeX answer without spacing, size, unit and percent marks; fractions, roots and decimals in one form."""
    text = _replaced(text, LATEX_REPLACED)
    if text.count(UNITS) > 1:
        raise ValueError("units twice")
    text = _replaced(text.partition(UNITS)[0], LATEX_AFTER_UNITS)
    text = "0" + text if text.startswith(".") else text
    if text.count("=") == 1 and text.index("=") <= 2:  # a name such as `x =`
        text = text.partition("=")[2]
    text = _braces_given(text, "\\sqrt", 1).replace(" ", "")
    text = _braces_given(text, "\\frac", 2)
    whole = r"(0|-?[1-9]\d*)"
    return "\\frac{1}{2}" if text == "0.5" else re.sub(rf"\A{whole}/{whole}\Z", r"\\frac{\1}{\2}", text)


def latex_equal(a: str | None, b: str | None) -> bool:
    """Whether two answers are the same in plain form; where one can't be read, whether they are the same text."""
    if a is None or b is None:
        return a is b
    try:
        return latex_plain(a) == latex_plain(b)
    except ValueError:
        return a == b


def tool_call_score(truth: list[dict], predicted: list[dict], high: float = 3.0, low: float = -3.0) -> float:
    """Names, parameter names and values of calls; each true call takes the best unused predicted one of its name."""

    def similar(a: list, b: list) -> float:
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        both = sum(min(a.count(x), b.count(x)) for x in set(a))
        return both / (len(a) + len(b) - both)

    if truth == predicted:
        return high
    score, most, free = similar([t["name"] for t in truth], [p["name"] for p in predicted]), 1.0, list(predicted)
    for t in truth:
        want = t["parameters"]
        most += 1.0 + len(want)
        rated = [(similar(list(want), list(p["parameters"])) + sum(k in p["parameters"] and p["parameters"][k] == v for k, v in want.items()), -i) for i, p in enumerate(free) if p["name"] == t["name"]]
        if rated and max(rated)[0] > 0:
            best, i = max(rated)
            score += best
            free.pop(-i)
    return (high - low) * score / most + low


def _syntax_error(lines: list[str]) -> int:
    """The line, from 1, of the first error in Python code; 0 without."""
    try:
        ast.parse("\n".join(lines))
    except SyntaxError as e:
        return max(e.lineno or 1, 1)
    except (ValueError, MemoryError, RecursionError):
        return len(lines)
    return 0


def longest_code(text: str) -> str:
    """Of the runs of two lines or more that Python parses the one with most lines that are not blank; of equal ones the first, and
    of these the shortest. Without one, the first line.

    An error in line k of a run stays for every longer run from the same line, so the longest run is cut before k and tried again.
    """
    lines = text.split("\n")
    filled = [bool(line.strip()) for line in lines]
    before = [0, *accumulate(filled)]  # lines that are not blank before each line
    ends = [i + 1 for i, f in enumerate(filled) if f]
    best, kept = 0, (0, 1)
    for begin in range(len(lines) - 1):
        if before[-1] - before[begin] <= best:
            break
        end = max(ends[-1], begin + 2) if ends else 0
        while end >= begin + 2 and before[end] - before[begin] > best:
            error = _syntax_error(lines[begin:end])
            last = ends[before[end] - 1]
            if error and lines[last - 1].endswith("\\"):  # blank lines behind a backslash can end its statement
                blank = [e for e in range(end + 1, min(last + 2, len(lines)) + 1) if not any(filled[end:e])]
                found = next((e for e in blank if not _syntax_error(lines[begin:e])), None)
                error, end = (0, found) if found else (error, end)
            if not error:
                best, kept = before[end] - before[begin], (begin, end)
                break
            end = min(end - 1, begin + max(error - 1, 0))
            # a run ends with a line that is not blank, unless it would be too short
            end = max(ends[before[end] - 1] if before[end] else 0, min(end, begin + 2))
    return "\n".join(lines[slice(*kept)])


def python_literal(text: str | None) -> str | None:
    """A Python or JSON literal as JSON; null where it is neither."""
    if text is None:
        return None
    for parse in (json.loads, ast.literal_eval):
        try:
            return json.dumps(parse(text), sort_keys=True)
        except (ValueError, SyntaxError, TypeError):
            pass
    return None


def finance_number(text: str | None, percent: bool = True) -> float | None:
    """Number of an answer: currency signs, LaTeX text and thousands commas go, percent is divided by 100, (x) is -x, a/b is a fraction."""
    t = re.sub(r"\\text\{[^}]*\}", "", text or "").replace("\\$", "").replace("$", "").strip()
    share = "%" in t
    t = t.replace("\\%", "").replace("%", "").replace(",", "").strip()
    if t.startswith("(") and t.endswith(")"):
        t = "-" + t[1:-1]
    try:
        value = float(t)
    except ValueError:
        value = -fraction(t[1:]) if t.startswith("-") and "/" in t and fraction(t[1:]) is not None else fraction(t) if "/" in t else None
    return value / 100 if share and percent and value is not None else value


def finance_match(predicted: str | None, truth: str | None, rel: float = 0.01, absolute: float = 1.0) -> float:
    """1 where numbers agree within both bounds (for a truth of 0: under 0.001), percent read either way; several boxes match one by one; else equal texts."""
    boxes = re.findall(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}", truth or "")
    wanted = boxes or [truth or ""]
    given = re.split(r"[,;]\s+", (predicted or "").strip()) if len(wanted) > 1 else [predicted or ""]
    if len(given) != len(wanted):
        return 0.0

    def one(p: str, t: str) -> bool:
        if len(wanted) > 1:
            p = re.sub(r"^[^:]*:\s*", "", p)
        if own := re.findall(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}", p):
            p = own[-1]
        y = finance_number(t)
        if y is None:
            return p.strip().lower() == t.strip().lower()
        for x in (finance_number(p), finance_number(p, False)):
            if x is not None and (abs(x) < 0.001 if y == 0 else abs(x - y) <= rel * abs(y) and abs(x - y) <= absolute):
                return True
        return False

    return float(all(map(one, given, wanted)))


def fraction(text: str) -> float | None:
    try:
        return float(Fraction(text))
    except (ValueError, ZeroDivisionError):
        return None


@F.pandas_udf(T.StringType())
def boxed_udf(s: pd.Series) -> pd.Series:
    return s.map(boxed, na_action=None)


@F.pandas_udf(T.StringType())
def final_answer_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else final_answer(x))


@F.pandas_udf(T.BooleanType())
def latex_equal_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([latex_equal(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def tool_call_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([tool_call_score(json.loads(x), json.loads(y)) for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def longest_code_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: longest_code(x or ""))


@F.pandas_udf(T.StringType())
def python_literal_udf(s: pd.Series) -> pd.Series:
    return s.map(python_literal, na_action=None)


@F.pandas_udf(T.DoubleType())
def finance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([finance_match(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.LongType())
def word_overlap_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """As multiset_overlap, in linear time: for the words of long texts."""
    return pd.Series([0 if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(T.StructType([T.StructField("correct", T.BooleanType()), T.StructField("answer", T.StringType())]))
def minerva_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None or y is None else minerva(x, y) for x, y in zip(a, b)], columns=["correct", "answer"])


@F.pandas_udf(T.StructType([T.StructField("correct", T.BooleanType()), T.StructField("answer", T.StringType())]))
def minerva_boxed_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None or y is None else minerva(x, y, True) for x, y in zip(a, b)], columns=["correct", "answer"])


@F.pandas_udf(T.StructType([T.StructField("score", T.IntegerType()), T.StructField("answer", T.StringType())]))
def strict_box_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if x is None or y is None else strict_box(x, y) for x, y in zip(a, b)]
    return pd.DataFrame({"score": pd.Series([r[0] for r in rows], dtype="Int32"), "answer": pd.Series([r[1] for r in rows], dtype="object")})


def weight_map_udf(response_map: dict[str, list[float]], query_map: dict[str, list[float]] | None = None):
    @F.pandas_udf("array<struct<content: string, weight: double>>")
    def weights(query: pd.Series, response: pd.Series) -> pd.Series:
        rows = [None if r is None else weight_map(q, r, response_map, query_map) for q, r in zip(query, response)]
        return pd.Series([None if w is None else [{"content": c, "weight": x} for c, x in w] for w in rows], dtype="object")

    return weights
