"""Extension points: row functions, batched rewards and metrics with state."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_rows(df: DataFrame, preprocess: Callable[[dict], dict | list[dict] | None], schema: str, strict: bool = False) -> DataFrame:
    """preprocess gives a row, several or none. A row on which it fails is dropped, or with `strict` fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                try:
                    got = preprocess(row)
                except Exception:
                    if strict:
                        raise
                    continue
                out += [] if got is None else got if isinstance(got, list) else [got]
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return df.mapInArrow(run, schema)


def table_function(preprocess: Callable[[dict], dict | list[dict] | None], schema: str, columns: list[str] | None = None):
    """preprocess as a table function of SQL, for spark.udtf.register: `f(TABLE(t))` gets each row of a table, which may be partitioned and
    ordered there; `t, LATERAL f(a, b)` gets values, under the names in `columns`. A row on which preprocess fails, fails the query.
    """
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    class RowFunction:
        def eval(self, *values):
            whole = len(values) == 1 and isinstance(values[0], T.Row)
            got = preprocess(values[0].asDict(recursive=True) if whole else dict(zip(columns or [], values, strict=True)))
            for row in [] if got is None else got if isinstance(got, list) else [got]:
                yield tuple(row.get(n) for n in names)

    return F.udtf(RowFunction, returnType=schema, useArrow=True)


def batched_reward(f: Callable[..., list[float]]):
    """A vectorised reward over column batches as a pandas UDF."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(f(*[c.tolist() for c in columns]), dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


def metric(df: DataFrame, key: str, value: str, kind: type) -> DataFrame:
    """key, value: a metric class with update, merge and compute. Each task keeps a state a key; only states are shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            frame = batch.to_pandas()
            for k, part in frame.groupby("key"):
                states.setdefault(k, kind()).update(part["value"].tolist())
        if states:
            yield pa.RecordBatch.from_pydict({"key": pa.array([str(k) for k in states]), "state": pa.array([pickle.dumps(vars(s)) for s in states.values()], pa.binary())})

    def final(table: pa.Table) -> pa.Table:
        total = None
        for raw in table["state"].to_pylist():
            one = kind()
            vars(one).update(pickle.loads(raw))
            if total is None:
                total = one
            else:
                total.merge(one)
        return pa.table({"key": table["key"].slice(0, 1), "value": pa.array([float(total.compute())])})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value")).filter("key is not null and value is not null")
    return rows.mapInArrow(partial, "key string, state binary").groupBy("key").applyInArrow(final, "key string, value double")


class Registry:
    """Named implementations of one kind of extension; a name can be taken once."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str, made: Callable | None = None):
        """Registers a function or class; without one, a decorator."""
        if made is None:
            return lambda f: self.register(name, f)
        if name in self._known:
            raise ValueError(f"{self.kind} {name} is registered already")
        self._known[name] = made
        return made

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise ValueError(f"no {self.kind} {name}; there are {sorted(self._known)}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


#: Samplers: (df, n, key, seed) -> DataFrame. Replay samplers: classes with sample(groups, n), groups having uid and step.
#: Scorers: () -> Column of a data source.
SAMPLERS, REPLAY, SCORERS = Registry("sampler"), Registry("replay sampler"), Registry("scorer")


@SAMPLERS.register("hashed")
def hashed(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The first n rows in hash order."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


@SAMPLERS.register("in order")
def in_order(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(key).limit(n)


@REPLAY.register("oldest")
class Oldest:
    """The groups with the smallest step."""

    def sample(self, groups: DataFrame, n: int) -> DataFrame:
        return groups.orderBy("step", "uid").limit(n)


def dispatched(source, scorers: dict) -> Column:
    """The score by data source; a source without a scorer, null too, makes the query fail when it runs."""
    score = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double")
    for name, value in scorers.items():
        score = F.when(source == name, value).otherwise(score)
    return score


def keep_episodes(df: DataFrame, keep: Callable[[DataFrame], object]) -> tuple[DataFrame, DataFrame]:
    """(episodes kept, one row with `kept` and `dropped`): keep gets the table and gives a condition; a null condition drops."""
    condition = F.coalesce(keep(df), F.lit(False))
    return df.filter(condition), df.agg(F.count_if(condition).alias("kept"), F.count_if(~condition).alias("dropped"))
