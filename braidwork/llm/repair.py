"""Repair of the turn structure of conversations, as one higher-order fold in Spark SQL.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant turn. Rows are kept, given
another role, deleted, or preceded by an inserted empty turn; the cheapest such edits win, and of equally cheap ones the audit, an
initial an edit, that sorts first.

Windows flag each row's first fault (blank, repeated, cut short); the rows of a conversation are collected as sorted structs, and
aggregate() folds them, carrying for each of the four places that a repaired conversation can be at (nothing yet, behind the system
turn, a user turn, an assistant turn) the least (cost, audit) that leads there. Two audits of one cost over the same rows are never one
the beginning of the other, as an insertion more would cost more; so the least stays the least whatever edits follow, and one pass is
enough. The role that an edit gives follows from the place; in the fold it is told by a letter of its own that sorts alike
(J, S for assistant instead of I, R), so the repaired turns are read off the audit.

Defined results: null roles and texts are one space; null turns come first, equal turns go by role, then text; rows equal in all columns
are rows of their own, and the later a duplicate; a null conv_id is a conversation like others; a role without a first letter fits no
place and cannot be kept. A conversation is one row by its result, so the turns of one are collected: its audit and its repaired text are single
values. Texts of any length are read whole. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
PLACES = ("start", "system", "user", "assistant")
_LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, live: rows damaged by a checksum of conversation and turn; a dropped row stays as one that is not live.

    Of twenty remainders five do harm: 0 drops the row, 1 empties its text, 2 takes its full stops and marks away, 3 repeats it, 4 makes it the user's.
    """
    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_space(conv_col), F.lit(":"), or_space(turn_col)).cast("binary")) % 20
    text = or_space(text_col)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(or_space(role_col)).alias("role"),
        text.alias("text"),
        (kind != 0).alias("live"),
        F.explode(times).alias("_copy"),
    )
    return rows.drop("_copy")


def flagged(rows: DataFrame) -> DataFrame:
    """Adds to conv_id, turn, role, text, live: `fault` (blank, duplicate, truncated or null), `illegal` and `new_turn`, of live rows."""
    # one shuffle: both windows and the gathering of a conversation are satisfied by it
    rows = rows.repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    of_conv = Window.partitionBy("conv_id", "live").orderBy(*order)
    same = Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = (
        F.when(F.trim(F.col("text"), F.lit(SPACES)) == "", F.lit("blank"))
        .when(F.row_number().over(same) > 1, F.lit("duplicate"))
        .when(~end.isin(".", "!", "?"), F.lit("truncated"))
    )
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(of_conv), initial)
    return rows.withColumns(
        {
            "fault": F.when(F.col("live"), fault),
            "illegal": F.col("live") & F.coalesce(~pair.isin(*_LEGAL), F.lit(False)),
            "new_turn": F.col("live") & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(of_conv)),
        }
    )


def _path(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.cast("string").alias("audit"))


def _nowhere() -> Column:
    return F.lit(None).cast("struct<cost:long,audit:string>")


def _step(path: Column, cost, letter: str, where: Column | None = None) -> Column:
    """The path with one edit more; none where there is no path or the edit is not allowed."""
    allowed = path.isNotNull() if where is None else path.isNotNull() & where
    return F.when(allowed, _path(path["cost"] + cost, F.concat(path["audit"], F.lit(letter))))


def _least(*paths: Column) -> Column:
    return F.least(*paths)


def _with_insertions(places: dict[str, Column]) -> Column:
    """The four places, each also reached by insertions from the others. A user turn comes first, so two steps are all that can pay."""
    start, system, user, assistant = (places[p] for p in PLACES)
    user_ = _least(user, *[_step(p, INSERT, "I") for p in (start, system, assistant)])
    assistant_ = _least(assistant, _step(user_, INSERT, "J"))
    return F.struct(start.alias("start"), system.alias("system"), user_.alias("user"), assistant_.alias("assistant"))


def _fold_turn(at: Column, turn: Column) -> Column:
    """One row more, whatever is done with it."""
    start, system, user, assistant = (at[p] for p in PLACES)
    initial, free = turn["initial"], ~F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    more = F.when(turn["fault"] == "truncated", F.lit(CUT_SHORT)).otherwise(F.lit(0))
    before_user = (start, system, assistant)
    return _with_insertions(
        {
            "start": _step(start, DELETE, "D"),
            "system": _least(_step(system, DELETE, "D"), _step(start, KEEP + more, "K", free & (initial == "s"))),
            "user": _least(
                _step(user, DELETE, "D"),
                *[_step(p, KEEP + more, "K", free & (initial == "u")) for p in before_user],
                *[_step(p, REROLE + more, "R", free) for p in before_user],
            ),
            "assistant": _least(_step(assistant, DELETE, "D"), _step(user, KEEP + more, "K", free & (initial == "a")), _step(user, REROLE + more, "S", free)),
        }
    )


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array of turns (initial, fault), the audit with a letter for each role given."""
    zero = _with_insertions({"start": _path(F.lit(0), F.lit(""))} | {p: _nowhere() for p in PLACES[1:]})
    return F.aggregate(turns, zero, _fold_turn, lambda at: _least(at["start"], at["assistant"]))


def repaired(turns: Column, code: Column) -> Column:
    """`role:text` of the repaired turns, joined by newlines."""
    edits = F.regexp_extract_all(code, F.lit("[IJ]*[DKRS]"), F.lit(0))

    def inserted(letters: Column) -> Column:
        return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("I", "user:\n"), ("J", "assistant:\n")), letters)

    def lines(turn: Column, edit: Column) -> Column:
        own = F.right(edit, F.lit(1))
        role = F.when(own == "K", turn["role"]).when(own == "R", F.lit("user")).when(own == "S", F.lit("assistant"))
        return F.concat(inserted(F.regexp_replace(edit, "[DKRS]", "")), F.coalesce(F.concat(role, F.lit(":"), turn["text"], F.lit("\n")), F.lit("")))

    text = F.concat(F.array_join(F.zip_with(turns, edits, lines), ""), inserted(F.regexp_extract(code, "[IJ]*$", 0)))
    return F.substring(text, F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(0)))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired of every conversation of rows (conv_id, turn, role, text, live).

    Rows that are not live count only as a sign that their conversation is there.
    """
    # what repeats another row comes behind it
    turn = F.struct("turn", "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False)).alias("again"), "fault")

    def count(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")

    live_turn = F.when(F.col("live"), F.col("turn").cast("long"))
    convs = flagged(rows).groupBy("conv_id").agg(
        F.coalesce(F.max(live_turn) - F.min(live_turn) + 1 - count(F.col("new_turn")), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        # nulls sort first, then structs go by turn, role and text
        F.array_sort(F.collect_list(F.when(F.col("live"), turn))).alias("turns"),
    )
    told = F.transform("turns", lambda t: F.struct(F.substring(t["role"], 1, 1).alias("initial"), t["fault"].alias("fault")))
    convs = convs.withColumn("_best", cheapest(told))
    return convs.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
        F.col("_best.cost").alias("cost"),
        F.translate("_best.audit", "JS", "IR").alias("audit"),
        repaired(F.col("turns"), F.col("_best.audit")).alias("repaired"),
    )
