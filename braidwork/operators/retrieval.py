"""Vector and keyword retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.sources.shared import new_path


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


#: Cells of an index at most, rows that its quantiser is fitted on at most, rows of a block and queries of one.
MAX_CELLS, SAMPLE_ROWS, BLOCK, QUERY_BLOCK = 4096, 65_536, 2048, 256


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length == 0, 1, length)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _quantiser(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Centres of `cells` cells by spherical k-means over a sample of vectors of length one; an empty cell starts anew at a row."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        empty = np.bincount(near, minlength=len(centres)) == 0
        sums[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        centres = _unit(sums)
    return centres


@dataclass
class VectorIndex:
    """Inverted lists over the cells of a coarse quantiser. Every row is in the list of its nearest centre.

    `lists` has (cell, tier.., rows): blocks of a cell's rows. `widest` is the cosine between a cell's centre and the row farthest from it.
    """

    centres: np.ndarray
    widest: np.ndarray
    lists: DataFrame
    tiers: list[str]
    n_tiers: int

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query, of length one, and cell: the cosine to the centre, and the most that a row of the cell can have."""
        near = np.clip(unit @ self.centres.T, -1, 1)
        angle = np.arccos(near) - np.arccos(np.clip(self.widest, -1, 1))[None, :]
        most = np.where(angle <= 0, 1.0, np.cos(np.clip(angle, 0, np.pi)))
        return near, np.where(self.widest[None, :] < -1.5, -2.0, most)  # -2: no row is there


def vector_index(base: DataFrame, key: str = "vec_id", vector: str = "embedding", tier: str | None = None, cells: int | None = None, block: int = BLOCK, seed: int = 42) -> VectorIndex:
    """An index of all rows of base, written to the shared folder; the quantiser is fitted on at most SAMPLE_ROWS rows, the first by a hash of their key."""
    spark, tiers = base.sparkSession, [tier] if tier else []
    rows = base.select(*[F.col(t).cast("string").alias(t) for t in tiers], F.col(key).cast("long").alias("_id"), F.col(vector).alias("v")).filter("v is not null")
    total = rows.count()
    cells = min(cells or max(1, int(total**0.5)), MAX_CELLS, max(total, 1))
    sample = rows.select("_id", "v").orderBy(F.xxhash64("_id"), "_id").limit(min(SAMPLE_ROWS, max(64 * cells, 1024))).toArrow()
    units = _unit(_matrix(sample["v"].combine_chunks())) if len(sample) else np.zeros((1, 1))
    centres = _quantiser(units, min(cells, len(units)), seed=seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _unit(_matrix(batch.column("v"))) @ centres.T if batch.num_rows else np.zeros((0, len(centres)))
            cell = near.argmax(1)
            extra = {"cell": pa.array(cell, pa.int32()), "near": pa.array(near[np.arange(len(cell)), cell], pa.float64())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | extra)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    assigned, path = rows.mapInArrow(assign, f"{kinds}, cell int, near double"), new_path(spark, "vector-assigned")
    assigned.write.parquet(path)
    assigned = spark.read.parquet(path)
    stats = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("widest")).collect()  # a row a cell
    size, widest = np.zeros(len(centres), np.int64), np.full(len(centres), -2.0)
    for r in stats:
        size[r["cell"]], widest[r["cell"]] = r["n"], r["widest"] - 1e-9
    # a cell of many rows is as many blocks as it needs
    blocks = spark.createDataFrame([(i, int(-(-n // block)) or 1) for i, n in enumerate(size.tolist())], "cell int, _blocks int")
    spread = assigned.join(F.broadcast(blocks), "cell").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
    lists = spread.groupBy("cell", "_b", *tiers).agg(F.collect_list(F.struct("_id", "v")).alias("rows")).drop("_b")
    path = new_path(spark, "vector-lists")
    lists.write.parquet(path)
    n_tiers = assigned.select(*tiers).distinct().count() if tiers else 1
    return VectorIndex(centres, widest, spark.read.parquet(path), tiers, n_tiers)


def _scores(k: int, least: float, tiers: list[str]):
    """Of blocks of rows and of queries that meet: the k nearest rows of the block to each query, by one matrix product."""
    fields = [("query_id", pa.int64()), *[(t, pa.string()) for t in tiers], ("id", pa.int64()), ("similarity", pa.float64())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, queries = batch.column("rows")[i].values, batch.column("queries")[i].values
                ids, asks = rows.field("_id").to_numpy(), queries.field("_id").to_numpy()
                sim = _unit(_matrix(queries.field("v"))) @ _unit(_matrix(rows.field("v"))).T
                sim[asks[:, None] == ids[None, :]] = -np.inf
                sim[sim < least] = -np.inf
                near = np.lexsort((np.broadcast_to(ids, sim.shape), -np.round(sim, 12)), axis=1)[:, :k]
                keep = np.take_along_axis(sim, near, 1)
                a, b = np.nonzero(np.isfinite(keep))
                columns = {"query_id": pa.array(asks[a]), "id": pa.array(ids[near[a, b]]), "similarity": pa.array(keep[a, b])}
                for t in tiers:
                    columns[t] = pa.array([batch.column(t)[i].as_py()] * len(a), pa.string())
                yield pa.RecordBatch.from_pydict(columns, schema=pa.schema(fields))

    return score, ", ".join(f"`{n}` {'string' if t == pa.string() else 'double' if t == pa.float64() else 'long'}" for n, t in fields)


def _ranked(found: DataFrame, k: int, tiers: list[str]) -> DataFrame:
    w = Window.partitionBy("query_id", *tiers).orderBy(F.round("similarity", 12).desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def index_top_k(index: VectorIndex, queries: DataFrame, k: int, least: float, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, exact: bool = True, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, (tier,) id, similarity, rank, by cosine, of at least `least`; ties go to the smaller id, and a query is not its own neighbour.

    A query first asks the lists of its `probes` nearest cells (an eighth of all by default). With `exact`, it then asks every other cell
    whose farthest row could still be nearer than what it has; the result is that of comparing all rows. Without, that is left out.
    Queries meet lists by an equi-join on cells, in blocks of either.
    """
    score, schema = _scores(k, least, index.tiers)
    if (index.widest < -1.5).all():  # no rows
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    probes = min(probes or max(1, -(-len(index.centres) // 8)), len(index.centres))
    shared = queries.sparkSession.sparkContext.broadcast(VectorIndex(index.centres, index.widest, None, [], 1))
    asked = queries.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("v")).filter("v is not null")
    kinds = dict(asked.dtypes)["v"]

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 1024):
                    part = batch.slice(begin, 1024)
                    near, most = shared.value.bounds(_unit(_matrix(part.column("v"))))
                    chosen = np.zeros(near.shape, bool)
                    np.put_along_axis(chosen, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, 1)
                    if not first:
                        enough = part.column("_enough").to_numpy(zero_copy_only=False)
                        chosen = ~chosen & (most >= enough[:, None] - 1e-9)
                    a, cell = np.nonzero(chosen)
                    taken = part.select(["_id", "v"]).take(pa.array(a))
                    yield pa.RecordBatch.from_pydict({"_id": taken.column("_id"), "v": taken.column("v"), "cell": pa.array(cell, pa.int32())})

        return run

    def found(rows: DataFrame, first: bool) -> DataFrame:
        sent = rows.mapInArrow(route(first), f"_id long, v {kinds}, cell int")
        sent = sent.withColumn("_q", F.row_number().over(Window.partitionBy("cell", F.pmod(F.xxhash64("_id"), F.lit(64))).orderBy("_id")) / query_block)
        met = sent.groupBy("cell", F.pmod(F.xxhash64("_id"), F.lit(64)), F.floor("_q")).agg(F.collect_list(F.struct("_id", "v")).alias("queries"))
        pairs = index.lists.join(met.select("cell", "queries"), "cell").select("rows", *index.tiers, "queries")
        return _ranked(pairs.mapInArrow(score, schema), k, index.tiers)

    out = found(asked, True)
    if not exact:
        return out
    path = new_path(queries.sparkSession, "vector-found")
    out.write.parquet(path)
    out = queries.sparkSession.read.parquet(path)
    full = out.filter(F.col("rank") == k).groupBy(F.col("query_id").alias("_of")).agg(F.min("similarity").alias("_kth"), F.count("*").alias("_full"))
    enough = F.when(F.col("_full") == index.n_tiers, F.greatest("_kth", F.lit(float(least)))).otherwise(F.lit(float(least)))
    more = asked.join(full, F.col("_id") == F.col("_of"), "left").select("_id", "v", enough.alias("_enough"))
    return _ranked(out.drop("rank").unionByName(found(more, False).drop("rank")), k, index.tiers)


def cosine_top_k(base: DataFrame, queries: DataFrame, k: int, least: float, key: str = "vec_id", vector: str = "embedding", tier: str | None = None) -> DataFrame:
    """The k nearest rows of base to each query (of each tier), exactly, through an index made for them; see index_top_k."""
    return index_top_k(vector_index(base, key, vector, tier), queries, k, least, key, vector)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, hit: of each query's exact neighbours, how many were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("_hit").alias("hit"))


def compare_all(base: DataFrame, queries: DataFrame, k: int, least: float, key: str = "vec_id", vector: str = "embedding", tier: str | None = None, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """What index_top_k gives, by comparing every block of rows with every block of queries: what an index is measured against."""
    tiers = [tier] if tier else []
    spread = F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(base.select(F.count("*").alias("n")).scalar() / block)))
    packed = base.select(*tiers, F.col(key).cast("long").alias("_id"), F.col(vector).alias("v"), spread.alias("_b")).groupBy("_b", *tiers).agg(F.collect_list(F.struct("_id", "v")).alias("rows"))
    blocks = F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(queries.select(F.count("*").alias("n")).scalar() / query_block)))
    asked = queries.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("v"), blocks.alias("_q")).groupBy("_q").agg(F.collect_list(F.struct("_id", "v")).alias("queries"))
    score, schema = _scores(k, least, tiers)
    pairs = packed.select("rows", *[F.col(t).cast("string").alias(t) for t in tiers]).crossJoin(asked.select("queries"))
    return _ranked(pairs.mapInArrow(score, schema), k, tiers)


#: Questions that are sent to the texts at once, and their bytes; more go in several passes.
MAX_QUESTIONS, MAX_QUESTION_BYTES = 4096, 16 << 20


def keyword_top_k(docs: DataFrame, questions: DataFrame, key: str, text: str, question_key: str, question_text: str, k: int) -> DataFrame:
    """question, key, score, rank: sum over the question's distinct words of count / words of the text; rows without a common word don't count.

    A common word joins nearly all texts with nearly all questions, so questions go to the texts instead, a bounded number and size of
    them at once: a task scores its texts by one product of counts and passes on k rows a question and batch.

    Texts that share an id are one entry with the sum of their scores, questions that share an id are one of the distinct words
    of all; rows without id or text don't count. Texts of a repeated id are joined by word, since their sum is known only
    when all of them have been scored.
    """
    docs = docs.select(F.col(key).cast("long").alias(key), text).filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    asked = questions.select(F.col(question_key).cast("long"), question_text).filter(F.col(question_key).isNotNull() & F.col(question_text).isNotNull())
    # one row a question: the distinct words of all its rows
    asked = asked.select(F.col(question_key).alias("question"), _words(question_text).alias("words")).groupBy("question").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    n, size = asked.agg(F.count("*"), F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w)))).first()
    repeated = docs.groupBy(F.col(key).alias("_repeated")).count().filter("count > 1").select("_repeated")
    once = docs.join(repeated, docs[key] == repeated["_repeated"], "left_anti")
    more = docs.join(repeated, docs[key] == repeated["_repeated"], "left_semi")
    scored = _keyword_join(more, asked, key, text)
    passes = max(1, -(-n // MAX_QUESTIONS), -(-(size or 0) // MAX_QUESTION_BYTES))
    for i in range(passes):
        few = asked.filter(F.pmod(F.xxhash64("question"), F.lit(passes)) == i).collect()
        scored = scored.unionByName(_keyword_scan(once, [tuple(r) for r in few], key, text, k))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.round("score", 10).desc(), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _keyword_scan(docs: DataFrame, questions: list[tuple[int, list[str]]], key: str, text: str, k: int) -> DataFrame:
    ids = np.array([q for q, _ in questions], np.int64)
    names = {w: i for i, w in enumerate(sorted({w for _, words in questions for w in words}))}
    pairs = np.array([(names[w], q) for q, (_, words) in enumerate(questions) for w in words], np.int64).reshape(-1, 2)
    shared = docs.sparkSession.sparkContext.broadcast((ids, pa.array(list(names), pa.string()), pairs[np.argsort(pairs[:, 0], kind="stable")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, pairs = shared.value
        first = np.searchsorted(pairs[:, 0], np.arange(len(names) + 1))  # of the questions that have each word
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                lists = part.column("_words")
                size = np.diff(lists.offsets.to_numpy())
                word = pc.fill_null(pc.index_in(lists.flatten(), names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), size)
                # how often each text has each word that is asked for, then that share to each question with the word
                pair, count = np.unique(row[word >= 0] * len(names) + word[word >= 0], return_counts=True) if len(names) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                row, word = np.divmod(pair, max(1, len(names)))
                each = first[word + 1] - first[word]
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[word], each)
                keys, share = part.column("_key").to_numpy(), np.repeat(count / np.maximum(size[row], 1), each)
                flat = np.repeat(row, each) * len(ids) + pairs[at, 1]
                scores = np.bincount(flat, weights=share, minlength=part.num_rows * len(ids)).reshape(part.num_rows, len(ids))
                order = np.lexsort((np.broadcast_to(keys[:, None], scores.shape), -np.round(scores, 10)), axis=0)[:k]
                best = np.take_along_axis(scores, order, 0)
                a, q = np.nonzero(best > 0)
                yield pa.RecordBatch.from_pydict({"question": pa.array(ids[q]), key: pa.array(keys[order[a, q]]), "score": pa.array(best[a, q])})

    rows = docs.select(F.col(key).cast("long").alias("_key"), _words(text).alias("_words"))
    return rows.mapInArrow(run, f"question long, `{key}` long, score double")


def _keyword_join(docs: DataFrame, questions: DataFrame, key: str, text: str) -> DataFrame:
    """Words of texts are counted before they meet those of questions: one row a word and text on either side."""
    counted = docs.select(key, F.size(_words(text)).alias("_n"), F.explode(_words(text)).alias("_w")).groupBy(key, "_n", "_w").agg(F.count("*").alias("_c"))
    asked = questions.select("question", F.explode("words").alias("_w"))
    return counted.join(asked, "_w").groupBy("question", key).agg(F.sum(F.col("_c") / F.greatest("_n", F.lit(1))).alias("score"))


def clusters(df: DataFrame, key: str, vector: str, k: int, n_init: int = 20, iterations: int = 20, seed: int = 42) -> DataFrame:
    """key, cluster: k-means over vectors of length one. Of n_init runs, each from seeds of its own, the one with the least cost counts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = norm(vector)
    unit = F.transform(vector, lambda x: x.cast("double") / F.greatest(length, F.lit(1e-12)))
    rows = df.select(key, array_to_vector(unit).alias("features")).persist()
    try:
        models = [KMeans(k=k, seed=seed + i, maxIter=iterations).fit(rows) for i in range(n_init)]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()
    plain = df.select(key, array_to_vector(unit).alias("features"))
    return best.transform(plain).select(key, F.col("prediction").alias("cluster"))
