"""Runs of streaming queries to completion, increment by increment, over folders that all executors share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from braidwork.sources.files import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_increments(increments: list[DataFrame], transform: Callable[[DataFrame], DataFrame], mode: str = "append", rocksdb: bool = False) -> DataFrame:
    """Adds each increment to an input folder and lets a checkpointed query take what is new, as a job that is restarted would.

    The result has the rows of all micro-batches with `batch`, the id under which a micro-batch is written; a batch that is
    retried overwrites its own folder, so every batch counts once.
    """
    spark = increments[0].sparkSession
    source, sink, checkpoint = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    schema, shown = increments[0].schema, []
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if rocksdb:
        spark.conf.set(key, ROCKSDB)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    try:
        for part in increments:
            part.write.mode("append").parquet(source)
            stream = transform(spark.readStream.schema(schema).parquet(source))
            shown[:] = [stream.schema]
            query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        if rocksdb:
            spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    out = spark.read.option("basePath", sink).schema(shown[0].add("batch", "long") if "batch" not in shown[0].names else shown[0])
    return out.parquet(sink)


def metric_sink(increments: list[DataFrame], name: str, value: str) -> DataFrame:
    """Metrics of a stream as a file sink keeps them: per micro-batch name, sum and count, then summed over batches."""
    from pyspark.sql import functions as F

    rows = run_increments(increments, lambda s: s.select(F.col(name).alias("name"), F.col(value).cast("double").alias("value")))
    return rows.groupBy("name").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
