"""Indexed shards and rows by their places in files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from braidwork.sources import files, indexed


def made(spark, tmp_path, rows=1000, **options):
    indexed.register(spark)
    path = f"file://{tmp_path}/shards"
    df = spark.range(rows, numPartitions=3).select("id", F.concat(F.lit("row "), F.col("id").cast("string")).alias("t"), F.array("id").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") / 4).alias("d"))
    write = df.write.format("indexed").option("path", path)
    for k, v in options.items():
        write = write.option(k, v)
    write.mode("append").save()
    return path, df


def read(spark, path, rows=None, schema="ordinal long, id long, t string, a array<long>, d double"):
    reader = spark.read.format("indexed").schema(schema)
    return (reader.option("rows", rows) if rows else reader).load(path)


def test_shards_are_read_by_place(spark, tmp_path):
    path, df = made(spark, tmp_path, shardBytes=3000, groupRows=16)
    shards = json.load(open(f"{tmp_path}/shards/_manifest.json"))["shards"]
    assert len(shards) > 6 and sum(s[1] for s in shards) == 1000
    assert sorted(map(str, read(spark, path).drop("ordinal").collect())) == sorted(map(str, df.collect()))
    got = read(spark, path, "998-999, 3,15-40,16-17").collect()
    assert sorted(r["ordinal"] for r in got) == [3, *range(15, 41), 998, 999] and all(r["id"] == r["ordinal"] and r["a"] == [r["id"]] for r in got)
    assert [tuple(r) for r in read(spark, path, "42", "t string").collect()] == [("row 42",)]
    for wrong in ("1000", "5-2", "-3"):
        with pytest.raises(Exception, match="not among|invalid literal"):
            read(spark, path, wrong).collect()


def test_reads_touch_the_bytes_of_the_index_alone(spark, tmp_path):
    """All bytes but those of the groups asked for are overwritten, and all files of other shards are gone."""
    path, _ = made(spark, tmp_path, shardBytes=1 << 30, groupRows=10)
    shards = json.load(open(f"{tmp_path}/shards/_manifest.json"))["shards"]
    import numpy as np

    name = shards[1][0]
    index = np.fromfile(f"{tmp_path}/shards/{name}.idx", np.int64).reshape(-1, 3)
    first, (row, offset, size) = shards[0][1], index[4].tolist()
    data = bytearray(open(f"{tmp_path}/shards/{name}.bin", "rb").read())
    data[:offset], data[offset + size :] = b"x" * offset, b"x" * (len(data) - offset - size)
    open(f"{tmp_path}/shards/{name}.bin", "wb").write(data)
    for other, _, _ in (shards[0], shards[2]):
        os.remove(f"{tmp_path}/shards/{other}.bin")
    got = read(spark, path, f"{first + row}-{first + row + 9}").collect()
    assert [r["id"] for r in got] == list(range(first + row, first + row + 10))


def test_only_the_manifest_counts(spark, tmp_path):
    path, df = made(spark, tmp_path, 30)
    open(f"{tmp_path}/shards/shard-of-a-lost-task.bin", "wb").write(b"junk")
    assert read(spark, path).count() == 30
    with pytest.raises(Exception, match="boom"):  # a task that fails leaves nothing that counts
        bad = df.withColumn("t", F.when(F.col("id") == 29, F.raise_error(F.lit("boom"))).otherwise(F.col("t")))
        bad.write.format("indexed").option("path", path).mode("append").save()
    assert read(spark, path).count() == 30
    df.write.format("indexed").option("path", path).mode("append").save()
    assert [r["id"] for r in read(spark, path, "0,30").collect()] == [0, 0]
    df.limit(0).write.format("indexed").option("path", path).mode("overwrite").save()
    assert read(spark, path).count() == 0
    with pytest.raises(Exception, match="another schema"):
        df.select("id").write.format("indexed").option("path", path).mode("append").save()
    with pytest.raises(Exception, match="no _manifest"):
        read(spark, f"file://{tmp_path}/nothing").collect()


def test_rows_by_their_places_in_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    for i, (a, b) in enumerate(((0, 70), (70, 71), (71, 200))):
        spark.range(a, b, numPartitions=1).select("id", (F.col("id") * 2).alias("x")).write.parquet(f"{path}/f{i}")
    df = spark.read.parquet(f"{path}/f0", f"{path}/f1", f"{path}/f2")
    index = files.ordinal_index(df, ["id", "x"], rows=200)
    assert len(index.files) == 3 and index.first == [0, 70, 71]
    got = files.by_ordinal(df, index, [199, 0, 70, 71, 0]).collect()
    assert sorted((r["ordinal"], r["id"], r["x"]) for r in got) == [(i, i, 2 * i) for i in (0, 70, 71, 199)]
    # files without a row asked for are not read
    lost = "/" + index.files[0].partition(":")[2].lstrip("/")
    open(lost, "wb").write(b"no parquet")
    os.path.exists(crc := os.path.join(os.path.dirname(lost), f".{os.path.basename(lost)}.crc")) and os.remove(crc)
    assert [r["id"] for r in files.by_ordinal(df, index, [100]).collect()] == [100]
    for wanted in ([200], [-1]):
        with pytest.raises(IndexError):
            files.by_ordinal(df, index, wanted)
    with pytest.raises(ValueError, match="missing"):
        files.ordinal_index(df, ["y"])
    with pytest.raises(ValueError, match="expected"):
        files.ordinal_index(spark.read.parquet(f"{path}/f1"), rows=2)
