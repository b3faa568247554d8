"""The toxicity model learns from every row that it may learn from, in blocks."""

from pyspark.sql import functions as F

from braidwork.llm import toxicity


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """A word that is toxic only in rows behind the first 6000 by hash is learned; blocks hold every row that may be learned from once."""
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 1 << 20, raising=False)
    ids = spark.range(9000).filter(toxicity.fold(F.col("id")) != 0).orderBy(F.xxhash64("id"), "id")
    place = {r[0]: n for n, r in enumerate(ids.collect())}
    docs = []
    for i in range(9000):
        bad = "rotten" if place.get(i, 0) >= 6000 and i % 2 else "vile" if i % 11 == 0 else "mild"
        docs.append((i, f"v{i % 300} {bad} v{i % 7}", "en"))
    labels = spark.createDataFrame([(i, int("mild" not in t)) for i, t, _ in docs], "doc_id long, toxic int")
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert sum("rotten" in t for _, t, _ in docs) > 200
    model = toxicity.fit(table, labels)
    asked = spark.createDataFrame([(1, "v1 rotten v2", "en"), (2, "v1 vile v2", "en"), (3, "v1 mild v2", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(asked, model).collect()} == {1: 1, 2: 1, 3: 0}
    blocks, found = toxicity.write_blocks(table, labels)
    assert blocks.count() > 2 and sum(found.values()) == len(place)
    assert blocks.agg(F.sum(F.octet_length("n") / 8)).first()[0] == len(place)


def test_toxicity_model_is_the_same_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 1 << 16)
    table = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("v"), F.col("id") % 40), F.when(F.col("id") % 3 == 0, "vile").otherwise("mild")).alias("text"), F.lit("en").alias("lang"))
    table = table.unionByName(table.filter("doc_id < 9"))
    labels = table.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).distinct()
    one, two = (toxicity.fit(table.repartition(n), labels.repartition(n)) for n in (1, 5))
    assert (one.embed == two.embed).all() and (one.out == two.out).all() and (one.moved, one.thresholds) == (two.moved, two.thresholds)
