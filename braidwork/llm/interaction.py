"""Interaction audit of filters: what each would remove, in every order, by part of the corpus.

Each document gets a mask of the conditions it fails. Four are read off its own text. The fifth, a text that a smaller doc_id has
too, comes from a sort: rows are range-sorted by text fingerprint, full text and doc_id, so equal texts lie next to each other
whatever their number, and a group of copies is cut wherever a range ends. In a range a row is held against the one before it;
only rows that may be the first of their text, those at the head of a range with the id it begins with, cannot be decided there.
Every range also says with which texts it begins and ends and from which doc_id on; the least of these decides the heads.

Masks are then merged to counters of their part: for each of the 32 sets of filters, how many documents fail none of them. They
add up over rows in any order, and every figure of every order of filters is a difference of two of them, so the 120 orders cost no
pass over documents. A part is one row of 101 numbers until its 600 rows are written out.

Defined results: null and empty texts have no words and fail A alone, unless they repeat; null doc_ids count as larger than any
other, and rows that share text and doc_id are not each other's copies; a null source is the empty string; of repeated rows in
the labels any 1 counts, null labels don't; very long texts are read whole and compared whole; an empty table gives no rows. Only
the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resident import release
from .scratch import finished, materialise, recorded
from .tokencount import slices

FILTERS = "ABCDE"
#: The filter that needs other rows than its own.
COPIES = FILTERS.index("E")
_SETS = 1 << len(FILTERS)
_LAST = 2**63 - 1

JUDGED = "part string, doc_id long, mask int, head string, first long, boundary boolean"


def own_mask(text: Column) -> Column:
    """Bits of the conditions A to D that a text (not null) fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range: its copies marked, its undecided heads with the digest of their text, and its first and last texts as boundary rows."""
    release()
    text, first, at_head, edges = None, _LAST, True, []
    for batch in batches:
        ids = pc.fill_null(batch.column("doc_id"), _LAST).to_pylist()
        mask = batch.column("mask").to_pylist()
        head: list[str | None] = [None] * len(ids)
        for begin, texts in slices(batch.column("text")):
            for i, t in enumerate(texts, begin):
                if t != text:
                    at_head, text, first = text is None, t, ids[i]
                    digest = batch.column("_digest")[i].as_py()
                    if at_head:
                        edges.append((digest, first))
                if ids[i] > first:
                    mask[i] |= 1 << COPIES
                elif at_head:
                    head[i] = digest
        yield pa.RecordBatch.from_pydict(
            {
                "part": batch.column("part"),
                "doc_id": batch.column("doc_id"),
                "mask": pa.array(mask, pa.int32()),
                "head": pa.array(head, pa.string()),
                "first": pa.array(ids, pa.int64()),
                "boundary": pa.array([False] * len(ids), pa.bool_()),
            }
        )
    if text is not None:
        edges.append((digest, first))
        columns = {"part": [None, None], "doc_id": [None, None], "mask": [0, 0], "head": [e[0] for e in edges], "first": [e[1] for e in edges], "boundary": [True, True]}
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(columns.items(), kinds)})


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, doc_id, mask of every row: bit i is set where it fails filter i of FILTERS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # the last key parts rows that are equal in the others, so that no group of them is bound to one range
    last = [F.col("doc_id").asc_nulls_last(), F.col("_row")]
    rows = rows.withColumns({"_print": F.xxhash64("text"), "_digest": F.sha2(F.col("text").cast("binary"), 256), "_row": F.monotonically_increasing_id()})
    # the driver samples the keys of ranges: there a digest stands for the text, in the order as in the ranges
    sorted_ = rows.repartitionByRange("_print", "_digest", *last).sortWithinPartitions("_print", "_digest", "text", *last)
    judged = materialise(sorted_.select("part", "doc_id", "text", "_digest", own_mask(F.col("text")).alias("mask")).mapInArrow(_compare, JUDGED), "audit-masks")
    # at most two rows a range; every head finds its text among them
    edges = materialise(judged.filter("boundary").groupBy(F.col("head").alias("_of")).agg(F.min("first").alias("_least")), "audit-edges")
    rows = judged.filter("not boundary")
    heads = rows.filter("head is not null").join(edges, F.col("head") == F.col("_of"))
    copy = F.when(F.col("first") > F.col("_least"), F.lit(1 << COPIES)).otherwise(F.lit(0))
    heads = heads.select("part", "doc_id", F.col("mask").bitwiseOR(copy).alias("mask"))
    return rows.filter("head is null").select("part", "doc_id", "mask").unionByName(heads)


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each part one row: `pass_all`, `pass_good`, `pass_toxic` hold, for each set of filters (a number of FILTERS' bits), the documents failing none of it; `alone` those failing one filter only."""
    # rows of one id are merged first, so that an id that many rows share is no hot key of the join
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_of")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marks = marks.filter("good or toxic")
    rows = rows.join(marks, F.col("doc_id") == F.col("_of"), "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )

    def passing(c: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(c)).otherwise(0)) for s in range(_SETS)])

    alone = F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(FILTERS))])
    return rows.groupBy("part").agg(passing("n").alias("pass_all"), passing("good").alias("pass_good"), passing("toxic").alias("pass_toxic"), alone.alias("alone"))


def _orders() -> Column:
    """Every order and step: the filters before it and with it as numbers, and the place of its filter."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            name = "".join(FILTERS[i] for i in order)
            out.append(f"named_struct('name', '{name}', 'step', {step}, 'before', {before}, 'upto', {before | 1 << f}, 'of', {f})")
            before |= 1 << f
    return F.expr(f"array({', '.join(out)})")


def _shapley() -> Column:
    """For each filter, what it removes at its step, summed over all orders: each set of filters before it stands for the orders it begins."""
    n, out = len(FILTERS), []
    for f in range(n):
        parts = []
        for s in range(_SETS):
            if not s & 1 << f:
                k = s.bit_count()
                parts.append(factorial(k) * factorial(n - 1 - k) * (F.col("pass_all")[s] - F.col("pass_all")[s | 1 << f]))
        out.append(sum(parts[1:], parts[0]))
    return F.array(*out)


def report(counted: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = counted.withColumn("_shapley", _shapley()).withColumn("_at", F.explode(_orders()))

    def passes(c: str, of: str) -> Column:
        return F.col(c)[F.col(f"_at.{of}")]

    gone = {c: passes(c, "before") - passes(c, "upto") for c in ("pass_all", "pass_good", "pass_toxic")}
    fails = F.col("pass_all")[0] - F.col("pass_all")[F.expr("shiftleft(1, _at.of)")]
    return rows.select(
        "part",
        F.col("_at.name").alias("filter_order"),
        F.col("_at.step").alias("step"),
        passes("pass_all", "upto").alias("kept"),
        gone["pass_all"].alias("removed"),
        (fails - gone["pass_all"]).alias("redundant"),
        F.col("alone")[F.col("_at.of")].alias("unique_fails"),
        gone["pass_good"].alias("good_lost"),
        gone["pass_toxic"].alias("toxic_lost"),
        F.col("_shapley")[F.col("_at.of")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The report of all orders, for each part and step. labels has doc_id, quality and toxic."""
    with recorded() as worked:
        counted = counters(failure_masks(docs, id_col, text_col, part_col), labels)
    return report(finished(counted, "audit-counters", worked))
