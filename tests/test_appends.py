"""Appends that commit, and row functions as table functions."""

import pytest

from braidwork.functions import extend
from braidwork.functions import text as tx
from braidwork.sources import files


def test_appends_hold_each_id_once(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/log", "id long, v string"
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], schema)
    log = files.AppendLog(spark, path, schema, "id")
    assert log.read().count() == 0 and sorted(r["id"] for r in log.append(rows([1, 2, 2], "a")).collect()) == [1, 2]
    assert [r["id"] for r in log.append(rows([2, 3], "b")).collect()] == [3]
    # a run that fails before its commit leaves nothing, and its rerun writes each id once
    monkeypatch.setattr(log, "_claim", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.append(rows([4, 5], "lost"))
    monkeypatch.undo()
    assert sorted(r["id"] for r in log.read().collect()) == [1, 2, 3]
    # another run commits between this one's writing and its claim
    other = files.AppendLog(spark, path, schema, "id")
    claim, raced = log._claim, []

    def late(number, attempt):
        if not raced:
            raced.append(other.append(rows([5, 6], "other")).count())
        return claim(number, attempt)

    monkeypatch.setattr(log, "_claim", late)
    assert sorted(r["id"] for r in log.append(rows([4, 5, 7], "late")).collect()) == [4, 7] and raced == [2]
    assert sorted((r["id"], r["v"]) for r in files.read_appended(spark, path, schema).collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "late"), (5, "other"), (6, "other"), (7, "late")]
    # a marker of a run that ended while it claimed
    open(f"{tmp_path}/log/commits/00000004", "w").close()
    assert log.read().count() == 7 and log.append(rows([8, 1], "z")).count() == 1 and log.read().count() == 8


def test_row_functions_from_sql(spark):
    spark.createDataFrame([(1, "a b"), (2, ""), (3, "c")], "id long, t string").createOrReplaceTempView("lines_of_test")

    def words(row):
        return None if not row["t"] else [{"id": row.get("id"), "word": w} for w in row["t"].split()]

    spark.udtf.register("words_of_row", extend.table_function(words, "id long, word string"))
    spark.udtf.register("words_of_text", extend.table_function(words, "word string", ["t"]))
    assert sorted(map(tuple, spark.sql("SELECT * FROM words_of_row(TABLE(lines_of_test) PARTITION BY id)").collect())) == [(1, "a"), (1, "b"), (3, "c")]
    assert sorted(map(tuple, spark.sql("SELECT l.id, w.word FROM lines_of_test l, LATERAL words_of_text(l.t) w").collect())) == [(1, "a"), (1, "b"), (3, "c")]
    spark.udtf.register("fails_on_row", extend.table_function(lambda row: 1 / 0, "id long"))
    with pytest.raises(Exception, match="division"):
        spark.sql("SELECT * FROM fails_on_row(TABLE(lines_of_test))").collect()


def test_final_answers_keep_dollars_until_all_patterns_have_run():
    cases = {r"$\frac1$": r"\frac{1}{}", r"$\sqrt$": r"\sqrt{}", r"x = $\frac12$": r"\frac{1}{2}", r"$\sqrt2$ units": r"\sqrt{2}", r"\boxed{$3,000$}": "3000", "a $5$ b": "5", r"$\text{ab}$": "ab"}
    for text, want in cases.items():
        assert tx.final_answer(text) == want, text
