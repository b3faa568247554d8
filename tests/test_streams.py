"""Streaming editions that keep state: what increments and restarts give is what a batch gives."""

import datetime

import pytest

from braidwork.streaming import buffer, run

COLUMNS = "buffer string, line long, uid string, member long, status string, step long, request long, size long"


def news(line, uid, member, status, step, name="b"):
    return (name, line, uid, member, status, step, None, None)


def ask(line, request, now, size, name="b"):
    return (name, line, None, None, None, now, request, size)


def replayed(spark, parts, strategy, threshold):
    frames = [spark.createDataFrame(p, COLUMNS) for p in parts]
    out = run.run_increments(frames, lambda s: buffer.replay_stream(s, strategy, threshold), rocksdb=True).collect()
    return sorted((r["batch"], r["buffer"], r["action"], r["request"], r["uid"], r["member"], r["span"]) for r in out)


def test_replay_waits_for_enough_groups_and_forgets_what_it_gave(spark):
    parts = [
        [news(1, "u1", 0, "running", 1), news(2, "u1", 1, "finished", 2), news(3, "u2", 0, "failure", 3), ask(4, 1, 4, 2)],
        [news(5, "u3", 0, "pending", 4)],
        [news(6, "u1", 0, "finished", 9), ask(7, 2, 5, 1), news(8, "u3", 0, "finished", 4), news(9, "u1", 0, "finished", 5), ask(10, 3, 5, 5)],
    ]
    got = replayed(spark, parts, "keep", 0)
    # the first request is filled by news of the third increment; the second by what comes behind it; the third never
    assert got == [
        (2, "b", "sampled", 1, "u1", 0, 4), (2, "b", "sampled", 1, "u1", 1, 4), (2, "b", "sampled", 1, "u2", 0, 2),
        (2, "b", "sampled", 2, "u3", 0, 2),
    ]


def test_replay_drops_what_is_stale_and_waits_for_what_is_late(spark):
    rows = [news(1, "old", 0, "finished", 1), news(2, "new", 0, "finished", 4), news(3, "busy", 0, "running", 3)]
    assert replayed(spark, [rows, [ask(4, 1, 5, 1)]], "drop", 3) == [(1, "b", "dropped", 1, "old", 0, 5), (1, "b", "sampled", 1, "new", 0, 2)]
    assert replayed(spark, [rows, [ask(4, 1, 5, 1)]], "wait", 3) == []
    assert replayed(spark, [rows, [ask(4, 1, 5, 1)], [news(5, "busy", 0, "failure", 3)]], "wait", 3) == [(2, "b", "sampled", 1, "old", 0, 5)]
    assert replayed(spark, [rows, [ask(4, 1, 5, 2), news(1, "x", 0, "finished", 2, "c"), ask(2, 9, 2, 1, "c")]], "keep", 0) == [
        (1, "b", "sampled", 1, "new", 0, 2), (1, "b", "sampled", 1, "old", 0, 5), (1, "c", "sampled", 9, "x", 0, 1)
    ]
    with pytest.raises(ValueError, match="strategy"):
        buffer.ReplayProcessor("first", 1)


def test_replay_refuses_unknown_statuses(spark):
    with pytest.raises(Exception, match="unknown status"):
        replayed(spark, [[news(1, "u", 0, "lost", 1)]], "keep", 0)


def test_log_entries_meet_their_ends_over_increments(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    parts = [
        [("a", day(1), "started", 1.0), ("b", day(1), "started", 2.0), ("a", day(1), "started", 9.0)],
        [("c", day(2), "started", 3.0), ("late", day(2), "started", 4.0)],
        [("a", day(3), "complete", 5.0), ("d", day(3), "complete", 6.0)],
        [("late", day(9), "complete", 7.0), ("z", day(9), "started", 0.0)],
        [("y", day(28), "started", 0.0), ("y", day(28), "complete", 0.0)],
        [("y2", day(29), "started", 0.0), ("y2", day(29), "complete", 0.0)],
    ]
    frames = [spark.createDataFrame(p, "task string, at timestamp, status string, value double") for p in parts]
    out = run.run_increments(frames, lambda s: buffer.reconcile_stream(s, "task", "at", "status", "value", "4 DAYS", "1 day")).collect()
    got = sorted((r["task"], r["value"], r["complete"], r["started_at"] is not None, r["batch"]) for r in out if not r["task"].startswith("y"))
    assert [g[:4] for g in got] == [("a", 5.0, True, True), ("b", 2.0, False, True), ("c", 3.0, False, True), ("d", 6.0, True, False), ("late", 4.0, False, True), ("late", 7.0, True, False), ("z", 0.0, False, True)]


def increments(spark, rows, cuts, schema):
    return [spark.createDataFrame(rows[a:b], schema) for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def test_shuffled_streams_do_not_depend_on_where_increments_fall(spark):
    rows = [(s, i, i * 10 + s) for i in range(40) for s in (0, 1)] + [(0, 99, None), (1, 99, None)]
    schema, seen = "shard long, line long, ordinal long", []
    for cuts in ([], [1, 30, 31], [79]):
        out = run.run_increments(increments(spark, rows, cuts, schema), lambda s: buffer.shuffle_stream(s, "shard", "line", "ordinal", 8)).collect()
        seen.append(sorted((r["shard"], r["place"], r["ordinal"]) for r in out))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 80
    for s in (0, 1):
        own = [o for shard, _, o in seen[0] if shard == s]
        assert sorted(own) == [i * 10 + s for i in range(40)] and own != sorted(own)
        assert all(own.index(o) >= (o // 10) - 8 for o in own)  # a row comes out no earlier than the reservoir lets it


def test_interleaved_streams_wait_for_the_source_drawn_and_end_with_the_first(spark):
    rows = [(0, 0, i, i) for i in range(30)] + [(0, 1, i, 100 + i) for i in range(60)] + [(0, 0, 98, None), (0, 1, 99, None)]
    schema, seen = "shard long, source int, line long, ordinal long", []
    for order, cuts in ((rows, []), (rows, [10, 45]), (sorted(rows, key=lambda r: (r[2], r[1])), [20, 21])):
        out = run.run_increments(increments(spark, order, cuts, schema), lambda s: buffer.interleave_stream(s, "shard", "source", "line", "ordinal", [0.5, 0.5])).collect()
        seen.append(sorted((r["slot"], r["source"], r["ordinal"]) for r in out))
    assert seen[0] == seen[1] == seen[2]
    assert [x[0] for x in seen[0]] == list(range(len(seen[0]))) and sum(x[1] == 0 for x in seen[0]) == 30
    for source in (0, 1):
        own = [o for _, s, o in seen[0] if s == source]
        assert own == [100 * source + i for i in range(len(own))]
