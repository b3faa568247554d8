"""A staleness-bounded replay buffer: batch editions as DataFrame operators, and the streaming processors that keep the same state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from braidwork.operators.packing import STREAM_ITEMS, best_fit

TERMINAL = ("finished", "failure")


def keep_newest(df: DataFrame, queue: str, ordinal: str, size: int) -> DataFrame:
    """What a queue of `size` holds after all rows were put: the newest; with produced and dropped of the queue."""
    w = Window.partitionBy(queue)
    rows = df.withColumn("_n", F.row_number().over(w.orderBy(F.col(ordinal).desc()))).filter(F.col("_n") <= size).drop("_n")
    totals = df.groupBy(queue).agg(F.count("*").alias("produced"), F.greatest(F.count("*") - size, F.lit(0)).alias("dropped"))
    return rows.join(totals, queue)


def latest_status(df: DataFrame, keys: list[str], status: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(status, order).alias("status"), F.min_by("step", order).alias("step"))


def sampleable(df: DataFrame, uid: str) -> DataFrame:
    """Groups of which every member is finished or failed, with the age of the oldest. df: (uid, status, step)."""
    done = F.bool_and(F.col("status").isin(*TERMINAL))
    return df.groupBy(uid).agg(done.alias("_done"), F.min("step").alias("step")).filter("_done").drop("_done")


def fresh(df: DataFrame, now: int, most: int) -> DataFrame:
    """Rows whose span now - step + 1 is at most `most`; adds `span`."""
    return df.withColumn("span", F.lit(now) - F.col("step") + 1).filter(F.col("span") <= most)


def must_wait(df: DataFrame, now: int, most: int) -> DataFrame:
    """One row: whether an item that isn't done has reached the threshold."""
    late = ~F.col("status").isin(*TERMINAL) & (F.lit(now) - F.col("step") + 1 >= most)
    return df.agg(F.coalesce(F.bool_or(late), F.lit(False)).alias("wait"))


def take_oldest(groups: DataFrame, members: DataFrame, uid: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(members of the n oldest groups, members that stay)."""
    chosen = groups.orderBy("step", uid).limit(n).select(uid)
    return members.join(chosen, uid, "left_semi"), members.join(chosen, uid, "left_anti")


def refill_plan(target: int, total: int, done_each_step: list[int]) -> list[tuple[int, int, int]]:
    """(step, admitted, queued after) of a pool that is refilled to its target before each step, until everything is through."""
    queued, left, out = 0, total, []
    for step, done in enumerate(done_each_step):
        admitted = min(max(0, target - queued), left)
        left -= admitted
        queued = queued + admitted - min(done, queued + admitted)
        out.append((step, admitted, queued))
    return out


def refilled(items: DataFrame, done: DataFrame, step: str, taken: str, target: int) -> DataFrame:
    """step, admitted, queued of a pool refilled from a table's rows before each step, as refill_plan; done says what each step takes.

    A step depends on the one before, so the few rows of done, one a step, are folded by the driver.
    """
    steps = [r[1] for r in done.select(step, taken).orderBy(step).collect()]
    return items.sparkSession.createDataFrame(refill_plan(target, items.count(), steps), "step long, admitted long, queued long")


def save_batches(done: DataFrame, batch: str, index: str) -> None:
    """Adds the batches of a run to the saved index."""
    done.select(F.col(batch).cast("long").alias("batch")).distinct().write.mode("append").parquet(index)


def remaining_batches(df: DataFrame, batch: str, index: str) -> DataFrame:
    """The rows of batches that the saved index does not hold; all where there is no index yet."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(index)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return df
    done = spark.read.schema("batch long").parquet(index).distinct().withColumnRenamed("batch", "_done")
    return df.join(done, F.col(batch) == F.col("_done"), "left_anti")


def reconcile(df: DataFrame, task: str, line: str, status: str) -> DataFrame:
    """Log entries of a task merged: place of the first, values of the last complete one, else of the last."""
    complete = F.col(status).isNull() | (F.col(status) == "complete")
    return df.groupBy(task).agg(
        F.min(line).alias("first_line"),
        F.coalesce(F.max_by("value", F.when(complete, F.col(line))), F.max_by("value", line)).alias("value"),
        F.bool_or(complete).alias("complete"),
    )


def resample(df: DataFrame, valid: str, ordinal: str, wanted: int, attempts: int) -> DataFrame:
    """The first `wanted` valid rows among the first `attempts`."""
    tried = df.orderBy(ordinal).limit(attempts)
    return tried.filter(valid).orderBy(ordinal).limit(wanted)


STATUSES = ("pending", "running", *TERMINAL)

REPLAY_INPUT = "buffer string, line long, uid string, member long, status string, step long, request long, size long"
REPLAY_OUTPUT = "buffer string, action string, request long, uid string, member long, status string, span long"


class ReplayProcessor(StatefulProcessor):
    """transformWithStateInPandas: a replay buffer by name. A row with a status is news of a member of a group; one with a request asks for the
    `size` oldest groups at global step `step`.

    A group may be sampled when all its members are finished or failed; its step is the first that any of them had. With `drop`, groups
    whose span step - first + 1 exceeds the threshold go at the next request; with `wait`, a request waits while a member that is not
    done has reached it. A request waits until there are enough groups, and those behind it wait too; each is answered once, in
    the increment that fills it. What was sampled or dropped is forgotten, so the state holds the members of groups that still count and
    the requests that wait; news of a group that is gone begins it anew.
    """

    def __init__(self, strategy: str, threshold: int):
        if strategy not in ("drop", "wait", "keep"):
            raise ValueError("strategy is drop, wait or keep")
        self.strategy, self.threshold = strategy, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        member = StructType([StructField("uid", StringType()), StructField("member", LongType())])
        self.members = handle.getMapState("members", member, StructType([StructField("status", StringType()), StructField("step", LongType())]))
        self.waiting = handle.getListState("waiting", StructType([StructField(c, LongType()) for c in ("request", "step", "size")]))

    def _take(self, news: pd.DataFrame, held: dict) -> None:
        """The last status and the first step of each member; one write to the state a member, however much news of it there is."""
        wrong = set(news["status"]) - set(STATUSES)
        if wrong:
            raise ValueError(f"unknown status: {sorted(map(str, wrong))}")
        by = news.groupby(["uid", "member"], sort=False).agg(status=("status", "last"), step=("step", "first"))
        for (uid, member), status, step in by.itertuples():
            key = (uid, int(member))
            held[key] = (status, held[key][1] if key in held else int(step))
            self.members.updateValue(key, held[key])

    def _answer(self, request: tuple, held: dict) -> tuple[list[tuple], bool]:
        """Rows of what a request drops and samples, and whether it was filled."""
        number, now, size = request
        groups: dict[str, list] = {}
        for (uid, member), (status, step) in held.items():
            groups.setdefault(uid, []).append((member, status, step))
        span = {uid: now - min(m[2] for m in own) + 1 for uid, own in groups.items()}
        done = [uid for uid, own in groups.items() if all(m[1] in TERMINAL for m in own)]
        out = []

        def forget(action: str, uid: str) -> None:
            for member, status, _ in sorted(groups[uid]):
                out.append((action, number, uid, member, status, span[uid]))
                del held[uid, member]
                self.members.removeKey((uid, member))

        if self.strategy == "drop":
            for uid in sorted(u for u in done if span[u] > self.threshold):
                forget("dropped", uid)
            done = [u for u in done if span[u] <= self.threshold]
        late = self.strategy == "wait" and any(status not in TERMINAL and now - step + 1 >= self.threshold for status, step in held.values())
        if late or len(done) < size:
            return out, False
        for uid in sorted(done, key=lambda u: (-span[u], u))[:size]:
            forget("sampled", uid)
        return out, True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news = pd.concat(list(rows)).sort_values("line", kind="stable")
        held = {tuple(k): tuple(v) for k, v in self.members.iterator()} if self.members.exists() else {}
        waiting = [tuple(map(int, r)) for r in self.waiting.get()]
        out, asks = [], news["request"].notna().to_numpy()
        begin = 0
        # news up to a request, then the request, and so on; requests that wait are tried after all news before the next
        for end in [*np.flatnonzero(asks).tolist(), len(news)]:
            part = news.iloc[begin:end]
            if len(part):
                self._take(part, held)
            if end < len(news):
                waiting.append(tuple(int(news.iloc[end][c]) for c in ("request", "step", "size")))
            while waiting:
                made, filled = self._answer(waiting[0], held)
                out += made
                if not filled:
                    break
                waiting.pop(0)
            begin = end + 1
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in REPLAY_OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def replay_stream(stream: DataFrame, strategy: str = "drop", threshold: int = 2) -> DataFrame:
    """A stream of REPLAY_INPUT as a replay buffer that evicts what it gives; see ReplayProcessor. Needs a state store with column families."""
    return stream.groupBy("buffer").transformWithStateInPandas(ReplayProcessor(strategy, threshold), REPLAY_OUTPUT, "Append", "None")


def reconcile_stream(log: DataFrame, task: str, at: str, status: str, value: str, wait: str, delay: str) -> DataFrame:
    """task, started_at, started_value, completed_at, value, complete of a log stream: a started entry with the complete one of its task.

    A complete entry counts if it comes no earlier than the start and no later than `wait` after; rows more than `delay` behind the newest are too
    late. An entry that never ends comes out once, with its own value, when the watermark has passed all that it could wait for; so
    does an end without a start. Of entries of one kind and task within `delay`, the first counts. The state holds entries that still wait.
    """
    rows = log.select(F.col(task).alias("task"), F.col(at).alias("at"), F.col(status).alias("status"), F.col(value).alias("value")).withWatermark("at", delay)
    started = rows.filter("status = 'started'").dropDuplicatesWithinWatermark(["task"]).select("task", F.col("at").alias("started_at"), F.col("value").alias("started_value"))
    complete = rows.filter("status = 'complete'").dropDuplicatesWithinWatermark(["task"]).select(F.col("task").alias("_task"), F.col("at").alias("completed_at"), F.col("value").alias("completed_value"))
    near = (F.col("task") == F.col("_task")) & (F.col("completed_at") >= F.col("started_at")) & (F.col("completed_at") <= F.col("started_at") + F.expr(f"INTERVAL {wait}"))
    both = started.join(complete, near, "fullOuter")
    return both.select(
        F.coalesce("task", "_task").alias("task"),
        "started_at",
        "started_value",
        "completed_at",
        F.coalesce("completed_value", "started_value").alias("value"),
        F.col("_task").isNotNull().alias("complete"),
    )


class QueueProcessor(StatefulProcessor):
    """transformWithStateInPandas: a bounded FIFO by key; the oldest goes when it is full. Gives (queue, kept, produced, dropped) after each batch.

    The state holds at most `size` ordinals and two counters a key.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = StructType([StructField("ordinal", LongType())])
        self.items = handle.getListState("items", one)
        self.counts = handle.getValueState("counts", StructType([StructField("produced", LongType()), StructField("dropped", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.items.get()]
        produced, dropped = self.counts.get() if self.counts.exists() else (0, 0)
        new = sorted(x for pdf in rows for x in pdf["ordinal"].tolist())
        held += new
        produced += len(new)
        dropped += max(0, len(held) - self.size)
        held = held[-self.size :]
        self.items.put([(x,) for x in held])
        self.counts.update((produced, dropped))
        yield pd.DataFrame({"queue": [key[0]], "kept": [len(held)], "produced": [produced], "dropped": [dropped]})

    def close(self) -> None:
        pass


QUEUE_OUTPUT = "queue string, kept long, produced long, dropped long"


def bounded_queue(stream: DataFrame, queue: str, ordinal: str, size: int) -> DataFrame:
    """The streaming edition of keep_newest, for a streaming DataFrame with a string queue and a long ordinal."""
    rows = stream.select(F.col(queue).alias("queue"), F.col(ordinal).alias("ordinal"))
    return rows.groupBy("queue").transformWithStateInPandas(QueueProcessor(size), QUEUE_OUTPUT, "Update", "None")


def _in_order(frames: Iterator[pd.DataFrame], by: str, columns: list[str]) -> Iterator[tuple]:
    """The rows of a key in one increment, in order. They come in several frames where they are more than an Arrow batch holds, so each
    frame's order is not theirs. What is held are the named columns and the order, 8 bytes a value."""
    held = [pdf[[by, *(c for c in columns if c != by)]] for pdf in frames]
    if held:
        rows = (pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]).sort_values(by, kind="stable")
        yield from rows[columns].itertuples(index=False, name=None)


def pack_state(key, frames, state):
    """applyInPandasWithState: next-fit packing over a stream; the open pack is carried in the state."""
    capacity = key[1]
    # `some`: the open pack has an item, which may be of no length
    pack, held, some = state.get if state.exists else (0, 0, False)
    out = []
    for i, n in _in_order(frames, "ordinal", ["ordinal", "value"]):
        if some and held + n > capacity:
            pack, held = pack + 1, 0
        out.append((key[0], int(i), int(n), pack))
        held, some = held + int(n), True
        if held >= capacity:
            pack, held, some = pack + 1, 0, False
    state.update((pack, held, some))
    yield pd.DataFrame(out, columns=["shard", "ordinal", "value", "pack"])


def pack_stream(stream: DataFrame, shard: str, ordinal: str, value: str, capacity: int) -> DataFrame:
    """Next-fit packs of a stream whose micro-batches come in order of the ordinal; what is open stays until the next batch."""
    rows = stream.select(F.col(shard).cast("long").alias("shard"), F.lit(capacity).cast("long").alias("capacity"), F.col(ordinal).cast("long").alias("ordinal"), F.col(value).cast("long").alias("value"))
    return rows.groupBy("shard", "capacity").applyInPandasWithState(pack_state, "shard long, ordinal long, value long, pack long", "pack long, held long, some boolean", "append", "NoTimeout")


def bin_state(key, frames, state):
    """applyInPandasWithState: best-fit packing of every `interval` items; the last bin is held and packed anew with the next ones.

    A row without a value ends the shard: what is held is packed. The state holds one interval and one bin at most.
    """
    shard, capacity, interval = key
    packs, ordinals, values = state.get if state.exists else (0, [], [])
    held, out = list(zip(ordinals, values)), []
    # items of the interval that has begun stand behind the bin that is carried
    rows = _in_order(frames, "ordinal", ["ordinal", "value"])
    carried, waiting = ([x for x in held if x[1] < 0], [x for x in held if x[1] >= 0])
    carried = [(i, -n - 1) for i, n in carried]  # values of the carried bin are stored below zero

    def pack(last: bool) -> None:
        nonlocal carried, waiting, packs
        items = carried + waiting
        bins = best_fit([n for _, n in items], capacity) if items else []
        done = (max(bins) + 1 if last else max(bins)) if bins else 0
        out.extend((shard, i, n, packs + b) for (i, n), b in zip(items, bins) if b < done)
        carried, waiting, packs = [x for x, b in zip(items, bins) if b >= done], [], packs + done

    for i, n in rows:
        if pd.isna(n):
            pack(True)
            continue
        waiting.append((int(i), int(n)))
        if len(waiting) == interval:
            pack(False)
    held = [(i, -n - 1) for i, n in carried] + waiting
    state.update((packs, [i for i, _ in held], [n for _, n in held]))
    yield pd.DataFrame(out, columns=["shard", "ordinal", "value", "pack"])


def bin_stream(stream: DataFrame, shard: str, ordinal: str, value: str, capacity: int, interval: int = STREAM_ITEMS) -> DataFrame:
    """Packs of a stream by best fit, as packing.batched makes them of a table. A null value ends its shard."""
    rows = stream.select(F.col(shard).cast("long").alias("shard"), F.lit(capacity).cast("long").alias("capacity"), F.lit(interval).cast("long").alias("interval"), F.col(ordinal).cast("long").alias("ordinal"), F.col(value).cast("long").alias("value"))
    return rows.groupBy("shard", "capacity", "interval").applyInPandasWithState(bin_state, "shard long, ordinal long, value long, pack long", "packs long, ordinals array<long>, waiting array<long>", "append", "NoTimeout")


def _draw(*parts) -> int:
    """A number told by what it is drawn for, so that a restarted stream draws the same."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def shuffle_state(key, frames, state):
    """applyInPandasWithState: a reservoir of `size` rows; a row that comes when it is full takes the place of one that is drawn, which goes out.

    A row without an ordinal ends the shard: what is held goes out in drawn order.
    """
    shard, size, seed = key
    placed, held = state.get if state.exists else (0, [])
    held, out = list(held), []
    for (i,) in _in_order(frames, "line", ["ordinal"]):
        if pd.isna(i):
            out += [(shard, placed + n, x) for n, x in enumerate(sorted(held, key=lambda x: (_draw(seed, shard, "rest", x), x)))]
            placed, held = placed + len(held), []
        elif len(held) < size:
            held.append(int(i))
        else:
            at = _draw(seed, shard, placed) % size
            out.append((shard, placed, held[at]))
            held[at], placed = int(i), placed + 1
    state.update((placed, held))
    yield pd.DataFrame(out, columns=["shard", "place", "ordinal"])


def shuffle_stream(stream: DataFrame, shard: str, line: str, ordinal: str, size: int, seed: int = 42) -> DataFrame:
    """shard, place, ordinal: a stream in buffered random order, each shard through a reservoir of its own; every row goes out once.

    Rows of an increment come in order of `line`. The order depends on the seed and the rows alone, not on where increments or restarts fall.
    The state holds `size` ordinals a shard.
    """
    rows = stream.select(F.col(shard).cast("long").alias("shard"), F.lit(size).cast("long").alias("size"), F.lit(seed).cast("long").alias("seed"), F.col(line).cast("long").alias("line"), F.col(ordinal).cast("double").alias("ordinal"))
    return rows.groupBy("shard", "size", "seed").applyInPandasWithState(shuffle_state, "shard long, place long, ordinal long", "placed long, held array<long>", "append", "NoTimeout")


def interleave_state(shares: list[float]):
    """applyInPandasWithState: slot by slot the source that is drawn by its share gives its next row; a slot waits for it, and ends all if it has ended."""

    def run(key, frames, state):
        group, seed = key
        slot, sources, ordinals, ended, over = state.get if state.exists else (0, [], [], [], False)
        queues: list[list[int]] = [[] for _ in shares]
        for s, i in zip(sources, ordinals):
            queues[s].append(i)
        ended, out = set(ended), []
        for source, i in _in_order(frames, "line", ["source", "ordinal"]):
            ended.add(int(source)) if pd.isna(i) else queues[int(source)].append(int(i))
        taken = [0] * len(shares)
        while not over:
            u, pick = _draw(seed, group, slot) / 2**32, 0
            while pick < len(shares) - 1 and u >= sum(shares[: pick + 1]):
                pick += 1
            if taken[pick] == len(queues[pick]):
                over = pick in ended
                break
            out.append((group, slot, pick, queues[pick][taken[pick]]))
            taken[pick], slot = taken[pick] + 1, slot + 1
        left = [] if over else [(s, i) for s, q in enumerate(queues) for i in q[taken[s] :]]
        state.update((slot, [s for s, _ in left], [i for _, i in left], sorted(ended), over))
        yield pd.DataFrame(out, columns=["shard", "slot", "source", "ordinal"])

    return run


def interleave_stream(stream: DataFrame, shard: str, source: str, line: str, ordinal: str, shares: list[float], seed: int = 42) -> DataFrame:
    """shard, slot, source, ordinal of a stream whose rows name their source: the sources interleaved by probability until one is used up.

    A row without an ordinal ends its source. What has no slot yet waits in the state, so a source that runs ahead is held whole.
    """
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("probabilities sum to 1")
    rows = stream.select(F.col(shard).cast("long").alias("shard"), F.lit(seed).cast("long").alias("seed"), F.col(source).cast("int").alias("source"), F.col(line).cast("long").alias("line"), F.col(ordinal).cast("double").alias("ordinal"))
    return rows.groupBy("shard", "seed").applyInPandasWithState(interleave_state(shares), "shard long, slot long, source int, ordinal long", "slot long, sources array<int>, ordinals array<long>, ended array<int>, over boolean", "append", "NoTimeout")
