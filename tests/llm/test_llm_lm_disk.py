"""What op12's steps leave on disk and do over, by Spark's own counts of its stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import blocks as blockwise
from braidwork.llm import ngramlm


@pytest.fixture
def stages(spark):
    """Stages that ended since the last call, by Spark's status store."""
    sc, jvm = spark._jsc.sc(), spark._jvm
    seen = set()

    def new():
        sc.listenerBus().waitUntilEmpty()
        done = jvm.java.util.ArrayList()
        done.add(jvm.org.apache.spark.status.api.v1.StageStatus.COMPLETE)
        found = sc.statusStore().stageList(done, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        out = [s for s in (found.apply(i) for i in range(found.size())) if s.stageId() not in seen]
        seen.update(s.stageId() for s in out)
        return out

    new()
    return new


def test_words_of_blocks_are_not_shuffled_one_by_one(spark, make, texts, stages):
    """Joins as of tables that are too large to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    blocks = ngramlm.write_blocks(make(texts * 8), ~ngramlm.held_out(F.col("doc_id")), block_bytes=400_000)
    vocabulary = ngramlm.learn_words(blocks)
    stages()
    try:
        coded = ngramlm.code(blocks, vocabulary)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = sum(s.shuffleWriteRecords() for s in stages())
    entries = blocks.agg(F.sum("words")).first()[0]
    # the vocabulary crosses once; what blocks ask and are told is a row for a bucket
    assert coded.count() == blocks.count() and entries > 4 * vocabulary.distinct
    assert moved < vocabulary.distinct + entries / 10


def test_blocks_are_read_once_to_count(spark, make, texts, stages):
    blocks = ngramlm.write_blocks(make(texts), ~ngramlm.held_out(F.col("doc_id")), block_bytes=100_000)
    vocabulary = ngramlm.learn_words(blocks)
    coded = ngramlm.code(blocks, vocabulary)
    n = coded.count()
    stages()
    ngramlm.learn_and_answer(coded, vocabulary)
    assert sum(s.inputRecords() for s in stages() if s.shuffleWriteRecords()) == n > 1


def test_coded_words_in_two_hops(spark, make, texts, odd, monkeypatch):
    """The numbers of words that blocks get by way of bundles are those they get from buckets."""
    blocks = ngramlm.write_blocks(make(texts[:60] + odd), ~ngramlm.held_out(F.col("doc_id")), block_bytes=5000)
    vocabulary = ngramlm.learn_words(blocks)
    want = {r["block_id"]: bytes(r["payload"]) for r in ngramlm.code(blocks, vocabulary).collect()}

    class TwoHops(blockwise.Plan):
        def __init__(self, words, partitions, blocks=1):
            super().__init__(words, partitions, blocks)
            self.in_two_hops(3, blocks, words // blocks)
            self.bundles = 2

    monkeypatch.setattr(ngramlm, "Plan", TwoHops)
    found = ngramlm.code(blocks, vocabulary)
    assert {r["block_id"]: bytes(r["payload"]) for r in found.collect()} == want and len(want) > 10


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "u8"])
@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_planes_lay_bytes_of_equal_place_together(kind, n):
    values = np.random.default_rng(n).integers(0, 2 ** (8 * np.dtype(kind).itemsize - 1), n).astype(kind)[::-1]
    data = blockwise.planes(values)
    assert (blockwise.unplanes(data) == values).all() and blockwise.unplanes(data).dtype == values.dtype
    assert not n or blockwise.unsqueeze(data[10:]) == np.ascontiguousarray(values).view(np.uint8).reshape(n, -1).T.tobytes()


def test_shards_of_any_number_get_their_triples_in_order(spark, make, texts):
    blocks = ngramlm.write_blocks(make(texts[:200]), F.lit(True))
    vocabulary = ngramlm.learn_words(blocks)
    c = ngramlm.Coded(ngramlm.code(blocks, vocabulary).first()["payload"], vocabulary.docs)
    c.triples()
    few, many = (list(ngramlm.Routes(n).cut(c)) for n in (2**16, 2**16 + 1))
    for cuts in (few, many):
        assert [s for s, _ in cuts] == sorted({s for s, _ in cuts}) and all((np.diff(at) > 0).all() for _, at in cuts)
        assert sorted(np.concatenate([at for _, at in cuts]).tolist()) == list(range(len(c.z)))
