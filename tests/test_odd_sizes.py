"""Queries on tables whose sizes are no round numbers, against their SQL."""

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as driver
from braidwork.operators import packing
from braidwork.streaming import buffer, run


def documents(folder, sizes):
    """A folder with documents of these lengths, numbered from 0."""
    n = len(sizes)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": ["x"] * n, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array(sizes, pa.int64())}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("n", [51, 97, 100])
def test_equal_sizes_of_odd_shards(spark, tmp_path, n):
    sf = documents(tmp_path, [(i * 7919) % 331 for i in range(n)])
    oracle.same(driver.queries()["B06_equal_sizes"](spark, sf), oracle.connect(sf), driver.oracle_sql()["B06_equal_sizes"])


@pytest.fixture
def small_batches(spark):
    """Arrow batches of 7 rows, so that what a key gets in one increment comes in several."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["B04_stream_packing", "R10_stream_shuffle"])
def test_streams_are_in_order_over_arrow_batches(spark, tmp_path, small_batches, name):
    sf = documents(tmp_path, [(i * 7919) % 9973 for i in range(203)])
    table = pq.read_table(f"{sf}/documents.parquet")
    pq.write_table(table.take([(i * 89) % 203 for i in range(203)]), f"{sf}/documents.parquet")
    oracle.same(driver.queries()[name](spark, sf), oracle.connect(sf), driver.oracle_sql()[name])


def test_bins_and_interleaved_streams_are_in_order_over_arrow_batches(spark, small_batches):
    lengths = [(i * 37) % 50 for i in range(203)]
    mixed = [(i * 89) % 203 for i in range(203)]
    rows = spark.createDataFrame([(0, i, lengths[i]) for i in mixed] + [(0, 203, None)], "shard long, line long, n long").coalesce(1)
    out = run.run_increments([rows], lambda s: buffer.bin_stream(s, "shard", "line", "n", 60, 32)).collect()
    assert [r["pack"] for r in sorted(out, key=lambda r: r["ordinal"])] == packing.batched(lengths, 60, 32)
    rows = spark.createDataFrame([(0, i % 2, i, i) for i in mixed], "shard long, source int, line long, ordinal long").coalesce(1)
    out = run.run_increments([rows], lambda s: buffer.interleave_stream(s, "shard", "source", "line", "ordinal", [0.5, 0.5])).collect()
    for source in (0, 1):
        own = [r["ordinal"] for r in sorted(out, key=lambda r: r["slot"]) if r["source"] == source]
        assert len(own) > 50 and own == [source + 2 * i for i in range(len(own))]
