"""A corpus pipeline of five stages, each one of the operators of `braidwork.llm`; it counts as part of that subpackage.

Every stage takes what the one before kept, written as Parquet and read again. All but the last return the columns of
documents. Which rows go: toxic ones by the threshold of their language; all but the largest doc_id of equal texts; all but the
smallest doc_id of a component of near copies; contaminated ones. The last encodes what is left.

Exactly the rows judged go, whatever their ids: a row with a null doc_id goes if a row with an id has its text or is in its
component, and stays where all have none; rows that share an id are judged by their own texts, and those of the kept id that
are equal or near copies of each other all stay.

Texts that are null or empty are documents like others: all of them but one go as exact copies. An empty table gives no rows; columns of
any name pass through, but for those that begin with an underscore. Rows that tie go by the rules above; ties beyond them stay.

The toxicity stage's model and thresholds come from all labelled rows that may be learned from.

Near copies are those of op6's contract, 4 words and 85 percent, so that the stage drops what the query op6_jaccard_join links.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import bpecodec, decontaminate, exactdedup, jaccard, toxicity
from braidwork.llm.scratch import drop, materialise, recorded


#: Rows to drop that a task of the exact stage may hash, about 200 bytes each.
HASHED_ROWS = 100_000


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows of equal id and text are judged alike, so id and digest tell the rows to drop
    judged = exactdedup.dedup(docs).filter("not kept").select(F.col("doc_id").alias("_dropped"), "text_sha256")
    judged = materialise(judged.distinct(), "dropped")
    # hashed only where every task's share is small, so that the texts need not be sorted for the join
    if judged.count() <= HASHED_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")):
        judged = judged.hint("shuffle_hash")
    digest = F.sha2(exactdedup.normalised(docs["text"]).cast("binary"), 256)
    return docs.join(judged, docs["doc_id"].cast("long").eqNullSafe(judged["_dropped"]) & (digest == judged["text_sha256"]), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # components are of rows, told by a key of their own, whatever the ids
    keyed = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = jaccard.similarity_components(keyed, id_col="_row").select(F.col("doc_id").alias("_of"), F.col("component_id").alias("_component"))
    found = materialise(found, "components")
    large = found.filter("_of <> _component").select("_component").distinct()
    member = found.join(large, "_component", "left_semi").join(keyed.select("_row", F.col("doc_id").cast("long").alias("_id")), F.col("_of") == F.col("_row"))
    member = materialise(member.select("_of", "_component", "_id"), "members")
    first = member.groupBy(F.col("_component").alias("_first")).agg(F.min("_id").alias("_kept"))
    judged = member.join(first, F.col("_component") == F.col("_first")).filter("not (_id <=> _kept)").select("_of")
    return keyed.join(materialise(judged, "dropped"), F.col("_row") == F.col("_of"), "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpecodec.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", bpe_encoding),
]

#: The classifier cannot be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's result is written; what the stage worked with goes then, and its input once the next has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with recorded() as worked:
            out = stage(spark, docs, sf_dir)
        with recorded() as written:
            docs = materialise(out, f"stage-{name.replace(' ', '-')}")
        drop(spark, worked + before)
        before = written
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
