"""Chat formatting by event-sourced reconstruction.

A log has one event a row: (conv_id, seq, message, kind, role, text). Partitioned by conversation and message and sorted by seq, a
message's events fold to its final text: `start` gives the role, `delta` adds its text, `edit` puts its text in place of all
before, `regenerate` begins anew, `delete` removes the message. Folding is per message, so even a conversation that holds a
third of all events is folded in parallel; only final messages meet in the row of their conversation, which is the output.

Rendering writes `### role: text</turn>` and a line end per message, every `\\`, `#` and `<` of a text (and `:` of a role) after
a backslash, so control strings cannot arise from texts and unescaping is exact. Loss spans are code points of the output.

Defined results: null text is empty, null role is empty; an event delivered twice (equal in all columns) counts once; events of
one seq fold in order of kind, text; messages are ordered by the seq of their first event, then role, text and message; `seq` may be
of any type that orders, nulls first; a null conv_id is a conversation; messages equal in all but their name stay apart; very long texts
are whole, but a conversation must fit into one row (2 GB) and fails beyond it; empty logs give no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "conv_id long, seq long, message string, kind string, role string, text string"
FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,end:long>>"
RESETS = ("edit", "regenerate")

_IN_TEXT, _IN_ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, True)}: ", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        part = f"{head}{body}</turn>\n"
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises where the string is not one."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, seq, role, text) of a log; seq is that of the message's first event."""
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    # a repeated event has the same message, so repeats go where messages are gathered, with no shuffle of their own
    rows = events.select("conv_id", "message", event.alias("e")).groupBy("conv_id", "message").agg(F.array_sort(F.collect_set("e")).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i + 1))
    rows = rows.withColumn("from", F.coalesce(F.array_max(resets), F.lit(1)))
    live = F.slice("log", F.col("from"), F.size("log"))
    texts = F.filter(live, lambda e: e["kind"].isin("start", "delta", *RESETS))
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    rows = rows.filter(~F.exists("log", lambda e: e["kind"] == "delete"))
    return rows.select(
        "conv_id",
        "message",
        F.col("log")[0]["seq"].alias("seq"),
        F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(texts, lambda e: e["text"]), "").alias("text"),
    )


def _render_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": batch.column("conv_id"),
                "formatted": pa.array([m[0] for m in made], pa.string()),
                "loss": pa.array([[{"start": a, "end": b} for a, b in m[1]] for m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss of each conversation of a log."""
    turns = fold(events).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "message"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).mapInArrow(_render_rows, FORMATTED)


def as_log(messages: DataFrame, delta_chars: int = 200) -> DataFrame:
    """A log of (conv_id, turn, role, text) rows as a chat service would have written it.

    Texts are streamed in deltas; of some turns a draft comes first and is regenerated, of some a first version is edited. Rows
    that are equal in all columns stay separate messages. `seq` is (turn, step). Null turns come first, before negative ones; equal
    turns go by role, then text.
    """
    rows = messages.groupBy("conv_id", "turn", "role", "text").count()
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    text = F.coalesce("text", F.lit(""))
    # tells the messages of a conversation apart; format_log() orders them
    name = F.concat_ws(
        "|",
        F.coalesce(F.col("turn").cast("string"), F.lit("-")),
        F.coalesce("role", F.lit("")),
        F.sha2(text.cast("binary"), 256),
        F.col("role").isNull().cast("int").cast("string"),
        F.col("text").isNull().cast("int").cast("string"),
        F.col("copy").cast("string"),
    )
    n = F.greatest(F.ceil(F.char_length(text) / delta_chars), F.lit(1)).cast("int")
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    deltas = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct((i + 10).cast("long").alias("step"), F.lit("delta").alias("kind"), F.substr(text, i * delta_chars + 1, F.lit(delta_chars)).alias("text")),
    )

    def event(step: int, name: str, content):
        return F.struct(F.lit(step).cast("long").alias("step"), F.lit(name).alias("kind"), content.alias("text"))

    draft = F.array(event(0, "start", F.lit("")), event(1, "delta", F.lit("draft ### ")), event(2, "delta", F.reverse(F.substring(text, 1, 20))))
    history = (
        F.when(kind == 0, F.concat(draft, F.array(event(3, "regenerate", F.lit(""))), deltas))
        .when(kind == 1, F.concat(draft, F.array(event(3, "edit", text))))
        .otherwise(F.concat(F.array(event(0, "start", F.lit(""))), deltas))
    )
    rows = rows.select("conv_id", name.alias("message"), "turn", "role", F.explode(history).alias("e"))
    return rows.select(
        "conv_id",
        F.struct("turn", "e.step").alias("seq"),
        "message",
        F.col("e.kind").alias("kind"),
        F.when(F.col("e.kind") == "start", F.col("role")).alias("role"),
        F.col("e.text").alias("text"),
    )
