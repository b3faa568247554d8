"""Registered queries of the subpackage, and the pipeline against its stages done by hand."""

import hashlib
import re
import sys
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
import oracle
from braidwork.llm import queries


@pytest.fixture(scope="module")
def con():
    return oracle.connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    if name in queries.oracle_sql():
        oracle.same(df, con, queries.oracle_sql()[name])
    else:
        assert df.count() == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def test_pipeline(spark):
    from test_llm_operators import brute_contamination, brute_jaccard

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert left.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(up)].append(i)
    rows = [(i, t) for i, t in rows if i == max(groups[(t or "").translate(up)])]
    component = {d: c for d, _, c in brute_jaccard(rows)}
    rows = [(i, t) for i, t in rows if component[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = {d: (w, h) for d, w, h, _ in brute_contamination(rows, items)}
    rows = [(i, t) for i, t in rows if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_drop_the_rows_judged_whatever_their_ids(spark, make, sf):
    def left(stage, rows):
        out = stage(spark, make(rows), sf)
        assert out.columns == make([]).columns
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    exact = [(None, "Same"), (5, "same"), (7, "same"), (7, "other"), (5, "only five"), (None, "lone"), (None, "lone")]
    assert left(corpus_pipeline.exact_dedup, exact) == sorted(exact[2:], key=str)
    base, far = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(60))
    near = [(None, base + " tail"), (9, base + " end"), (3, base), (9, "only nine"), (3, "only three"), (None, far), (None, far + " end")]
    assert left(corpus_pipeline.near_dedup, near) == sorted(near[2:], key=str)


def test_stages_bear_odd_rows_and_empty_tables(spark, make, odd, sf):
    for rows in (odd, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == make([]).columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
        assert (docs.count() > 0) == bool(rows)


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    for p in (root / "braidwork").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"braidwork\.llm|from \.+llm|import llm", p.read_text()), p
