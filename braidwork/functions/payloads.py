"""Advice texts, test payloads, and sequence metrics that need more than one expression."""

from __future__ import annotations

import base64
import binascii
import io
import json
import math
import pickle
import pickletools
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of teacher prompts.
PLAN_MARK, SOLVED_MARK = "[Reference plan]", "This task is within your ability and can be solved directly."
ADVICE_HEAD, TAIL = "# Advice:", r"(?s)\n\n(?:\[User Question\]|Notice:).*"


def without_tail(prompt: Column) -> Column:
    """A teacher prompt up to the task or notice that follows it."""
    return F.regexp_replace(prompt, TAIL, "")


def advice_body(prompt: Column) -> Column:
    """What follows the head of the advice, or the whole prompt without one; the tail and outer space go."""
    body = without_tail(prompt)
    found = F.regexp_extract(body, rf"(?s){ADVICE_HEAD}\s*(.+)", 1)
    return F.regexp_replace(F.when(found != "", found).otherwise(body), r"(?U)^\s+|\s+$", "")


def prompt_type(prompt: Column) -> Column:
    return F.when(F.startswith(prompt, F.lit(PLAN_MARK)), "tool_chain").otherwise("advice")


def advice_kind(body: Column) -> Column:
    return F.when(F.contains(body, F.lit(SOLVED_MARK)), "positive").otherwise("corrective")


TESTS = "inputs array<string>, outputs array<string>, fn_name string"


def parsed_tests(raw: Column) -> Column:
    """Struct (inputs, outputs, fn_name) of a test payload; null where it is none: not JSON, lists empty or of unequal length, a blank function name."""
    p = F.from_json(raw, TESTS)
    named = F.get_json_object(raw, "$.fn_name")
    good = (F.size(p["inputs"]) > 0) & (F.size(p["inputs"]) == F.size(p["outputs"])) & (named.isNull() | (F.trim(named) != ""))
    return F.when(F.coalesce(good, F.lit(False)), p)


def pickled_text(data: bytes) -> str:
    """The string in a pickle that holds nothing else, read from its operations: nothing is ever unpickled."""
    text, rest = None, {"PROTO", "FRAME", "MEMOIZE", "PUT", "BINPUT", "LONG_BINPUT", "STOP"}
    for op, argument, _ in pickletools.genops(io.BytesIO(data)):
        if op.name in ("SHORT_BINUNICODE", "BINUNICODE", "BINUNICODE8", "UNICODE", "SHORT_BINBYTES", "BINBYTES", "BINBYTES8") and text is None:
            text = argument if isinstance(argument, str) else bytes(argument).decode("utf-8")
        elif op.name not in rest:
            raise ValueError("the pickle holds more than a string")
    if text is None:
        raise ValueError("the pickle holds no string")
    return text


def decode_tests(raw: str) -> list:
    """A list of tests as JSON, or base64 of zlib of a pickled JSON string; anything else is an error."""
    try:
        value = json.loads(raw)
    except ValueError:
        try:
            value = json.loads(pickled_text(zlib.decompress(base64.b64decode(raw, validate=True))))
        except (binascii.Error, zlib.error) as e:
            raise ValueError("neither JSON nor encoded tests") from e
    if not isinstance(value, list):
        raise ValueError("tests are a list")
    return value


@F.pandas_udf(T.StringType())
def encoded_tests(text: pd.Series) -> pd.Series:
    """JSON text as base64 of zlib of a pickled string."""
    return text.map(lambda t: base64.b64encode(zlib.compress(pickle.dumps(t))).decode(), na_action="ignore")


@F.pandas_udf(T.StringType())
def decoded_tests(raw: pd.Series) -> pd.Series:
    """decode_tests as JSON text; null where it fails."""

    def one(x):
        try:
            return None if x is None else json.dumps(decode_tests(x), ensure_ascii=False)
        except ValueError:
            return None

    return raw.map(one, na_action=None)


def info_nce(df: DataFrame, query: str, score: str, positive: Column) -> DataFrame:
    """By query: margin of the best positive over the best negative, and whether it is the best of all; null without either kind."""
    pos, neg = F.max(F.when(positive, F.col(score))), F.max(F.when(~positive, F.col(score)))
    return df.groupBy(query).agg((pos - neg).alias("margin"), (pos > neg).alias("top1"), F.avg(F.when(positive, F.col(score))).alias("mean_pos"), F.avg(F.when(~positive, F.col(score))).alias("mean_neg"))


#: Fixed value: labels that don't count.
IGNORED = -100


def label_hits(predictions: Column, labels: Column, shift: bool = True) -> Column:
    """array<boolean>: for each label that counts whether it was predicted. With shift, prediction i is of label i + 1. Null for unequal lengths."""
    p, t = (F.slice(predictions, F.lit(1), F.greatest(F.size(predictions) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))) if shift else (predictions, labels)
    pairs = F.filter(F.arrays_zip(p.alias("p"), t.alias("t")), lambda x: x["t"] != IGNORED)
    return F.when(F.size(predictions) == F.size(labels), F.transform(pairs, lambda x: F.coalesce(x["p"] == x["t"], F.lit(False))))


def token_accuracy(hits: Column) -> Column:
    return F.size(F.filter(hits, lambda x: x)) / F.nullif(F.size(hits), F.lit(0))


def sequence_accuracy(hits: Column) -> Column:
    return F.forall(hits, lambda x: x)


def ngrams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def f_measure(both: float, predicted: float, true: float) -> float:
    return 2 * both / (predicted + true) if both else 0.0


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def bleu(predicted: list[str], true: list[str], most: int = 4) -> float:
    """BLEU of a sentence: geometric mean of n-gram precisions times the brevity penalty.

    Precisions of 0 are smoothed by halving: the k-th of them counts as 1 / (2^k * its n-grams). Without a common word it is 0.
    """
    precisions, halves = [], 1
    for n in range(1, most + 1):
        own, theirs = ngrams(predicted, n), ngrams(true, n)
        both, total = (own & theirs).total(), max(1, own.total())
        if not both:
            if n == 1:
                return 0.0
            halves *= 2
        precisions.append(both / total if both else 1 / (halves * total))
    brevity = 1.0 if len(predicted) > len(true) else math.exp(1 - len(true) / len(predicted))
    return brevity * math.exp(sum(map(math.log, precisions)) / most)


OVERLAPS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")])


def overlaps(predicted: list[str], true: list[str]) -> dict[str, float] | None:
    """ROUGE-1, ROUGE-2 and ROUGE-L as F measures and BLEU-4 of two lists of words; none where either is empty."""
    if not predicted or not true:
        return None
    out = {}
    for n in (1, 2):
        a, b = ngrams(predicted, n), ngrams(true, n)
        out[f"rouge_{n}"] = f_measure((a & b).total(), a.total(), b.total())
    out["rouge_l"] = f_measure(common_subsequence(predicted, true), len(predicted), len(true))
    return out | {"bleu_4": bleu(predicted, true)}


@F.pandas_udf(OVERLAPS)
def overlaps_udf(predicted: pd.Series, true: pd.Series) -> pd.DataFrame:
    rows = [None if a is None or b is None else overlaps(list(a), list(b)) for a, b in zip(predicted, true)]
    return pd.DataFrame({c: [None if r is None else r[c] for r in rows] for c in OVERLAPS.names}, dtype="float64")
