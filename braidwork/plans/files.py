"""Queries of sources and sinks. What is read back has been written to the shared folder by the query itself."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.sources import files, indexed

from .registry import query, table

_NATION = "n_nationkey long, n_name string, n_regionkey long"


def _nation(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


_NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


@query("S01_load_by_extension", f"SELECT f, n.* FROM ({_NATIONS}) n, (SELECT unnest(['csv', 'jsonl', 'orc', 'parquet']) AS f)")
def s01(spark, sf):
    parts = []
    for ext in ("csv", "jsonl", "orc", "parquet"):
        path = files.new_path(spark, f"nation.{ext}")
        writer = _nation(spark, sf).write.format(files.FORMATS[ext])
        (writer.option("header", True) if ext == "csv" else writer).save(path)
        parts.append(files.load_file(spark, path, _NATION).withColumn("f", F.lit(ext)))
    return files.concatenated(parts)


@query("S02_load_splits", f"{_NATIONS} WHERE n_regionkey <= 2")
def s02(spark, sf):
    folder = files.new_path(spark, "splits")
    for name, test in (("train", "n_regionkey < 2"), ("test", "n_regionkey = 2")):
        _nation(spark, sf).filter(test).write.parquet(f"{folder}/{name}.parquet")
    return files.load_splits(spark, folder, ["train", "test"])


@query("S03_locator", f"{_NATIONS} WHERE n_nationkey < 25 AND n_regionkey IN (1, 3)")
def s03(spark, sf):
    at = files.parse_locator("hf::demo/nation:1/3#25")
    rows = _nation(spark, sf).filter(F.col("n_regionkey").isin([int(s) for s in at.subsets]))
    return rows.orderBy("n_nationkey").limit(at.rows)


@query("S04_subsets", f"{_NATIONS} WHERE n_regionkey IN (0, 1, 2, 4)")
def s04(spark, sf):
    known = [files.Subset(str(i), weak=i == 3) for i in range(5)]
    return _nation(spark, sf).filter(F.col("n_regionkey").cast("string").isin(files.select_subsets(known, ("all",))))


@query("S05_registry", _NATIONS)
def s05(spark, sf):
    registry = files.Registry()
    registry.register("demo/nation", lambda s, at: _nation(s, sf))
    return registry.load(spark, "other/nation")


@query("S06_training_files", f"SELECT * FROM ({_NATIONS}) UNION ALL SELECT * FROM ({_NATIONS})")
def s06(spark, sf):
    a, b = files.new_path(spark, "a.parquet"), files.new_path(spark, "b.jsonl")
    _nation(spark, sf).write.parquet(a)
    _nation(spark, sf).write.json(b)
    return files.training_files(spark, [a, b]).select("n_nationkey", "n_name", "n_regionkey")


@query("S07_parquet_concat", "SELECT o_orderkey AS key FROM orders UNION ALL SELECT c_custkey FROM customer")
def s07(spark, sf):
    a, b = files.new_path(spark, "a.parquet"), files.new_path(spark, "b.parquet")
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")).write.parquet(a)
    table(spark, sf, "customer").select(F.col("c_custkey").alias("key")).write.parquet(b)
    return files.training_files(spark, [a, b], ("parquet",))


@query("S08_tolerant_jsonl", "SELECT count(*) FILTER (event_id % 10 > 1) AS rows, count(*) FILTER (event_id % 10 = 1) AS errors FROM events")
def s08(spark, sf):
    path = files.new_path(spark, "log.txt")
    m = F.col("event_id") % 10
    table(spark, sf, "events").select(F.when(m == 0, F.lit("  ")).when(m == 1, F.lit("{broken")).otherwise(F.col("props")).alias("value")).write.text(path)
    return files.tolerant_jsonl(spark, path, T.StructType([T.StructField("k", T.LongType())]))[1]


@query("S09_dated_rows", "SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def s09(spark, sf):
    path = files.new_path(spark, "dated.jsonl")
    table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("day")).write.json(path)
    return files.dated_rows(files.load_file(spark, path, "event_id long, day string"), "day", "2024-01-05", "2024-01-09").select("event_id")


@query("S09_file_checksums", """
WITH t AS (SELECT n_regionkey, string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || chr(10), '' ORDER BY n_nationkey) AS content FROM nation GROUP BY 1)
SELECT sha256(content) AS sha256, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, n_regionkey AS region FROM t""")
def s09_sum(spark, sf):
    """A file for each region, and the digests of the files."""
    path = files.new_path(spark, "sums")
    rows = _nation(spark, sf).select("n_nationkey", "n_name", F.col("n_regionkey").alias("region"))
    rows.repartition("region").sortWithinPartitions("region", "n_nationkey").write.partitionBy("region").json(path)
    return files.file_checksums(spark, f"{path}/*").select("sha256", "bytes", F.regexp_extract("path", "region=(\\d+)/", 1).cast("int").alias("region"))


@query("S10_by_ordinal", "SELECT o AS ordinal, doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER () - 1 AS o FROM documents) WHERE o IN (0, 17, 150, 199)")
def s10(spark, sf):
    docs = table(spark, sf, "documents")
    index = files.ordinal_index(docs, ["doc_id", "n_chars"])
    return files.by_ordinal(docs, index, [150, 0, 17, 199]).select("ordinal", "doc_id", "n_chars")


@query("S11_csv_rows", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def s11(spark, sf):
    folder = files.new_path(spark, "summaries")
    for i in range(2):
        table(spark, sf, "customer").filter(F.col("c_custkey") % 2 == i).select("c_custkey", "c_name").write.option("header", True).csv(f"{folder}/{i}.csv")
    return files.load_file(spark, f"{folder}/*.csv", "c_custkey string, c_name string")


@query("S12_json_folder", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def s12(spark, sf):
    path = files.new_path(spark, "objects")
    rows = _nation(spark, sf).select("n_nationkey", "n_name")
    rows.repartitionByRange(25, "n_nationkey").write.option("maxRecordsPerFile", 1).json(path)
    return files.json_folder(spark, path, "n_nationkey long, n_name string").drop("file")


@query("S13_log_metrics", "SELECT event_id, unnest(['actor/loss', 'perf/time']) AS name, unnest([value, CAST(user_id AS DOUBLE)]) AS number FROM events")
def s13(spark, sf):
    line = F.concat(F.lit("\x1b[36m(step)\x1b[0m actor/loss:"), F.col("value").cast("string"), F.lit(" - perf/time:"), F.col("user_id").cast("string"))
    return files.log_metrics(table(spark, sf, "events").select("event_id", line.alias("value")))


@query("S14_guarded_sql", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY 1")
def s14(spark, sf):
    return files.guarded_sql(spark, {"t": table(spark, sf, "customer")}, "SELECT c_mktsegment, count(*) AS n FROM {t} WHERE c_acctbal > 1000 GROUP BY 1")


@query("S15_profile", """SELECT 'c_mktsegment' AS column, 'string' AS type, (SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer) AS "distinct" UNION ALL SELECT 'c_nationkey', 'int', NULL""")
def s15(spark, sf):
    return files.profile(table(spark, sf, "customer").select("c_mktsegment", F.col("c_nationkey").cast("int")))


@query("S16_sql_runner", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s16(spark, sf):
    sql = "SELECT r_name, count(*) AS n FROM {n} JOIN {r} ON n_regionkey = r_regionkey GROUP BY 1"
    return files.run_sql(sql, spark, n=table(spark, sf, "nation"), r=table(spark, sf, "region"))[0]


@query("S17_build_database", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s17(spark, sf):
    folder = files.new_path(spark, "database")
    for name in ("supplier", "nation"):
        table(spark, sf, name).write.parquet(f"{folder}/{name}.parquet")
    s, n = (files.load_file(spark, f"{folder}/{x}.parquet") for x in ("supplier", "nation"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("K01_parquet_sink", "SELECT o_orderkey, o_totalprice FROM orders")
def k01(spark, sf):
    path = files.new_path(spark, "k01.parquet")
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice").write.parquet(path)
    return files.load_file(spark, path)


@query("K02_jsonl_resume", "SELECT doc_id, lang FROM documents")
def k02(spark, sf):
    path = files.new_path(spark, "k02.jsonl")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    files.append_new(docs.filter("doc_id % 3 = 0"), path, "doc_id")
    files.append_new(docs, path, "doc_id")
    return files.read_appended(spark, path, docs.schema)


@query("K03_cache_export", "SELECT item_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS length FROM benchmark")
def k03(spark, sf):
    path = files.new_path(spark, "k03.parquet")
    ids = F.transform(F.split("text", " "), lambda w: F.crc32(w.cast("binary")))
    table(spark, sf, "benchmark").select("item_id", ids.alias("input_ids")).withColumn("length", F.size("input_ids").cast("long")).write.parquet(path)
    return files.load_file(spark, path).select("item_id", "length")


@query("K04_sharded_sink", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def k04(spark, sf):
    indexed.register(spark)
    path = files.new_path(spark, "k04-shards")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    rows.write.format("indexed").mode("append").option("path", path).option("shardBytes", 1 << 16).save()
    return spark.read.format("indexed").schema(rows.schema).load(path)


@query("K04_shard_ranges", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, c_custkey, c_name FROM customer QUALIFY ordinal BETWEEN 100 AND 139 OR ordinal = 7")
def k04_ranges(spark, sf):
    """Rows by place from shards that were written in order."""
    indexed.register(spark)
    path = files.new_path(spark, "k04-ranges")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_custkey")
    rows.write.format("indexed").mode("append").option("path", path).option("shardBytes", 4096).save()
    return spark.read.format("indexed").schema("ordinal long, c_custkey long, c_name string").option("rows", "100-139,7").load(path)


@query("K05_leaderboard_sink", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def k05(spark, sf):
    board = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    a, b = files.new_path(spark, "k05.csv"), files.new_path(spark, "k05.jsonl")
    board.coalesce(1).write.option("header", True).csv(a)
    board.coalesce(1).write.json(b)
    both = files.load_file(spark, a, "lang string, n long").intersect(files.load_file(spark, b, "lang string, n long"))
    return both


@query("K06_partitioned_sink", "SELECT vec_id, label FROM embeddings")
def k06(spark, sf):
    path = files.new_path(spark, "k06.parquet")
    table(spark, sf, "embeddings").select("vec_id", "label").write.partitionBy("label").parquet(path)
    return files.load_file(spark, path, "vec_id long, label int")


@query("K07_manifest", "SELECT count(*) AS rows, 42 AS seed, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 4) AS mean, CAST(sum(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)) % 1000000007 AS BIGINT) AS checksum FROM documents")
def k07(spark, sf):
    out = files.manifest(table(spark, sf, "documents"), F.col("doc_id"), F.col("n_chars"), 42)
    return out.withColumn("mean", F.round("mean", 4)).withColumn("checksum", (F.col("checksum") % 1_000_000_007).cast("long"))
