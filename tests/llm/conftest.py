import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) pairs, with a column whose name clashes with one that operators use inside."""
    from pyspark.sql import functions as F

    def docs(rows):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        return df.withColumns({c: F.lit("clash") for c in ("uid", "block_id", "digest", "n", "keep_id", "score", "_digest", "comp")})

    return docs


@pytest.fixture(scope="session")
def texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def odd():
    """Rows that operators must bear: null and empty texts, a null id, repeats, ties, a very long text."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, base), (7, base), (7, base), (8, base.upper()), (9, base + " tail"), (None, base), (10, "a b c"), (11, "A B C"), (12, "\x00 nul \x1c sep é Ⅷ 日本語 🙂")]
    rows += [(13, "intro " + base + " end"), (14, " ".join(f"x{i % 977}" for i in range(30_000))), (15, "word " * 5000)]
    return rows
