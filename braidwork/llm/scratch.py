"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import gc
import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from braidwork.sources import shared

_own = threading.local()


def _written() -> list[str]:
    """What this thread has written and not dropped."""
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def new_path(spark: SparkSession, name: str) -> str:
    path = shared.new_path(spark, name)
    _written().append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more go only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def finished(result: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """Writes a result whose rows are short, so that the tables it was made from, in paths, can go at once."""
    out = materialise(result, name)
    drop(result.sparkSession, paths)
    return out


def path_of(table: DataFrame) -> str:
    """The folder of a table that materialise() gave."""
    return table.inputFiles()[0].rpartition("/")[0]


def make_dir(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        if path in _written():
            _written().remove(path)


@contextmanager
def recorded():
    """Collects the paths written inside, so that a caller can drop them once their readers are done."""
    before = set(_written())
    paths: list[str] = []
    try:
        yield paths
    finally:
        paths.extend(p for p in _written() if p not in before)
