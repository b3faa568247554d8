"""Toxicity by a convolutional text classifier, trained in numpy.

A word (letters, digits and non-ASCII, A-Z lower-cased) is the sum of two hashed embeddings, of itself and of its first bytes,
so that unseen endings of a known stem count. Filters of several widths run over the words of the whole text; the largest
response of each, rectified, goes through a logistic layer. Embeddings begin at the log-odds of their bucket in the training
rows, shrunk to 0 for buckets that hardly occur, and are trained with filters and output by Adagrad.

Training: all labelled rows that may be learned from, with their whole texts. They are dealt to blocks of about BLOCK_BYTES by a
hash of what they hold, and written as word and stem numbers, a row a block. The log-odds are counted over all blocks. In every
epoch each block trains on from the shared model in batches of its rows; what weights moved by, and Adagrad's sums, are then averaged over the
blocks that moved them, in whole steps of GRAIN, so that neither the order of rows nor that of sums changes the model. The driver holds the
model and its sums, whose size is fixed, and no texts. About every fifth row is held back to calibrate: a shift puts the cut with the fewest errors
at 0.5, and each language with enough rows of both kinds gets a threshold of its own for `flagged`, from counts of all rows held back by steps of
1 / BINS of a logit; `predicted` always uses 0.5. Labels, language, source and id are never inputs of a score.

`max_rows` or `max_bytes` ask for less: a model of a sample, trained by the driver. No query asks for it.

Scoring takes two look-ups and one product with all places of all filters a word.

Defined results: null and empty texts get the score of a text without any word that counts; without labels of both kinds
every score is the share of toxic labels (0 if there are none); labels other than 0 and 1 or null are skipped; of repeated
label rows each counts, and of rows that share an id all are learned from; repeated documents get equal scores; very long texts are scored
whole; an empty table gives no rows. The model does not
depend on the order of rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import _TABLE
from .resident import release
from .scratch import collect_garbage, drop, materialise, recorded
from .tokencount import slices
from .words import encode, hashes, spans

WORD_BUCKETS, STEM_BUCKETS, STEM_BYTES = 1 << 18, 1 << 16, 5
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
#: Bytes of text of a block that is trained on at once, about.
BLOCK_BYTES = 6 << 20
#: Changes of weights are summed as multiples of this.
GRAIN = 2.0**-36
#: Steps of a logit that calibration tells apart, to 1.
BINS = 256
#: What a text counts for at least in BLOCK_BYTES, and in max_bytes where that is asked for.
LEAST_BYTES = 512
EPOCHS, BATCH, RATE = 6, 32, 0.15
FOLDS = 5
#: Rows of each kind that a language needs for a threshold of its own.
LANGUAGE_ROWS = 10
#: Words scored together.
CHUNK_WORDS = 60_000
#: Words of a training batch held at once.
TRAIN_WORDS = 1 << 19

SCORES = "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged int"


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Word and stem bucket of each word of a text."""
    return _buckets_of(encode(text).translate(_TABLE))


def _buckets_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    start, end = spans(data)
    word = (hashes(data, start, end) % np.uint64(WORD_BUCKETS)).astype(np.int32)
    stem = (hashes(data, start, end, STEM_BYTES) % np.uint64(STEM_BUCKETS)).astype(np.int32)
    return word, stem + WORD_BUCKETS


@dataclass
class Model:
    embed: np.ndarray  # (buckets + 1, DIM); the last row is the padding, 0
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    scale: float = 1.0
    moved: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Response of each filter's every place to each word: (words, places * FILTERS)."""
        return (self.embed[word] + self.embed[stem]) @ np.concatenate([w[o] for w in self.filters for o in range(len(w))], axis=1)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.moved, -30, 30)))

    def pool(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Largest responses over one text, before bias."""
        pad, top = len(self.embed) - 1, np.full(FILTERS * len(WIDTHS), -np.inf)
        last = max(WIDTHS) - 1
        word = np.r_[word, np.full(last + 1, pad)]
        stem = np.r_[stem, np.full(last + 1, pad)]
        for begin in range(0, len(word) - last, CHUNK_WORDS):
            cut = slice(begin, begin + CHUNK_WORDS + last)
            rows = self.responses(word[cut], stem[cut])
            n, place = len(rows) - last, 0
            for i, width in enumerate(WIDTHS):
                total = rows[:n, place * FILTERS : (place + 1) * FILTERS].copy()
                for o in range(1, width):
                    total += rows[o : n + o, (place + o) * FILTERS : (place + o + 1) * FILTERS]
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                top[part] = np.maximum(top[part], total.max(axis=0))
                place += width
        return top

    def pools(self, texts: list[str | None]) -> np.ndarray:
        """Largest responses of each text. Short texts lie end to end, so that a batch is one pass."""
        out, held, size = [], [], 0
        for text in texts:
            data = encode(text).translate(_TABLE)
            held.append(data)
            size += len(data)
            if size > 1 << 19:
                out.append(self._pool_batch(held))
                held, size = [], 0
        if held:
            out.append(self._pool_batch(held))
        return np.concatenate(out) if out else np.zeros((0, FILTERS * len(WIDTHS)))

    def _pool_batch(self, texts: list[bytes]) -> np.ndarray:
        if len(texts) == 1:
            return self.pool(*_buckets_of(texts[0]))[None]
        data = b" ".join(texts)
        word, stem = _buckets_of(data)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        first = np.searchsorted(spans(data)[0], begin)
        count = np.diff(np.r_[first, len(word)])
        # each text is followed by padding as long as the widest filter, which also stands for an empty text
        last, pad = max(WIDTHS), len(self.embed) - 1
        at = np.arange(len(word)) + np.repeat(np.arange(len(texts)), count) * last
        ids = np.full((2, len(word) + last * len(texts) + last), pad)
        ids[0, at], ids[1, at] = word, stem
        head = first + np.arange(len(texts)) * last
        top = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf)
        # whole texts at a time, about CHUNK_WORDS words
        i = 0
        total_len = len(word) + last * len(texts)
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(head, head[i] + CHUNK_WORDS)))
            a, b = head[i], head[j] if j < len(texts) else total_len
            rows = self.responses(ids[0, a : b + last], ids[1, a : b + last])
            n, place = b - a, 0
            for k, width in enumerate(WIDTHS):
                total = rows[:n, place * FILTERS : (place + 1) * FILTERS].copy()
                for o in range(1, width):
                    total += rows[o : n + o, (place + o) * FILTERS : (place + o + 1) * FILTERS]
                # windows begin at the text's words and at the first padding behind it; later ones would reach the next text
                bounds = np.stack([head[i:j] - a, head[i:j] - a + count[i:j] + 1], axis=1).ravel()
                top[i:j, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(total, bounds, axis=0)[::2]
                place += width
            i = j
        return top


def _seen(words: list[np.ndarray], stems: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How many texts of either label have each bucket."""
    seen = np.zeros((2, WORD_BUCKETS + STEM_BUCKETS), np.int64)
    for w, s, label in zip(words, stems, y):
        seen[int(label), np.unique(np.r_[w, s])] += 1
    return seen


def _start(seen: np.ndarray, pos: float, neg: float, rng: np.random.Generator) -> Model:
    n = WORD_BUCKETS + STEM_BUCKETS
    pos, neg = max(1.0, pos), max(1.0, neg)
    odds = np.log((seen[1] + 0.5) / (pos + 1)) - np.log((seen[0] + 0.5) / (neg + 1))
    odds *= np.clip((seen.sum(0) - 1) / 4, 0, 1)  # seen once: not at all
    direction = rng.normal(0, 0.3, DIM)
    direction[0] = 1.0
    embed = np.zeros((n + 1, DIM))
    embed[:-1] = np.clip(odds, -4, 4)[:, None] * direction / 4
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) + direction[None, :, None] * 0.5 for w in WIDTHS]
    total = FILTERS * len(WIDTHS)
    return Model(embed, filters, np.full(total, -0.3), np.full(total, 0.5), shift=-1.0)


@dataclass
class Sums:
    """Adagrad's sums of squares, as the weights of a model."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.05

    @classmethod
    def of(cls, m: Model) -> Sums:
        return cls(np.full(len(m.embed), 0.05), [np.full_like(w, 0.05) for w in m.filters], np.full_like(m.bias, 0.05), np.full_like(m.out, 0.05))


def _weights(pos: float, neg: float) -> tuple[float, float]:
    """What a row of label 0 and of label 1 weighs; the mean is 1."""
    more = max(1.0, 0.5 * neg / max(1, pos))
    mean = (more * pos + neg) / (pos + neg)
    return 1 / mean, more / mean


def train(words: list[np.ndarray], stems: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """A model of rows that one task holds."""
    rng, pos = np.random.default_rng(seed), float(y.sum())
    m = _start(_seen(words, stems, y), pos, len(y) - pos, rng)
    g, weight = Sums.of(m), np.where(y == 1, *_weights(pos, len(y) - pos)[::-1])
    for _ in range(EPOCHS):
        _epoch(m, g, words, stems, y, weight, rng)
    return m


def _epoch(m: Model, g: Sums, words: list[np.ndarray], stems: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """Trains once on every row, in batches in random order."""
    pad, last, total = len(m.embed) - 1, max(WIDTHS), FILTERS * len(WIDTHS)
    for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
        gap = np.full(last, pad, np.int32)
        ids = np.concatenate([a for i in batch for a in (words[i], gap)] + [gap])
        ids2 = np.concatenate([a for i in batch for a in (stems[i], gap)] + [gap])
        drop_ = rng.random(len(ids)) < 0.1
        ids[drop_] = pad
        ids2[drop_] = pad
        n = len(ids) - last
        first = np.cumsum([0] + [len(words[i]) + last for i in batch[:-1]])
        size = np.array([len(words[i]) for i in batch])
        pooled, where = np.full((len(batch), total), -np.inf), np.zeros((len(batch), total), np.int64)
        for begin in range(0, n, TRAIN_WORDS):
            end = min(n, begin + TRAIN_WORDS)
            x = m.embed[ids[begin : end + last]] + m.embed[ids2[begin : end + last]]
            owner = np.searchsorted(first, np.arange(begin, end), side="right") - 1
            head = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
            beyond = np.arange(begin, end) - first[owner] > size[owner]  # windows that would reach the next text
            for k, w in enumerate(m.filters):
                resp = sum(x[o : end - begin + o] @ w[o] for o in range(len(w)))
                resp[beyond] = -np.inf
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                # of equal responses the first counts, also across parts of a batch
                best = np.full((len(batch), FILTERS), np.nan)
                tops = np.maximum.reduceat(resp, head, axis=0)
                best[owner[head]] = np.where(tops > pooled[owner[head], part], tops, np.nan)
                at, f = np.nonzero(resp == best[owner])
                where[owner[at[::-1]], f[::-1] + k * FILTERS] = begin + at[::-1]
                pooled[owner[head], part] = np.maximum(pooled[owner[head], part], tops)
        h = np.maximum(pooled + m.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.shift, -30, 30)))
        dz = (p - y[batch]) * weight[batch] / len(batch)
        dh = dz[:, None] * m.out * (h > 0)
        d_out, d_bias, d_shift = h.T @ dz, dh.sum(0), dz.sum()
        rows, grads = [], []
        for k, w in enumerate(m.filters):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            d = dh[:, part]
            for o in range(len(w)):
                at = where[:, part] + o
                dw = np.einsum("bf,bfd->df", d, m.embed[ids[at]] + m.embed[ids2[at]])
                rows.append(at.ravel())
                grads.append((d[:, :, None] * w[o].T[None]).reshape(-1, DIM))
                g.filters[k][o] += dw**2
                w[o] -= RATE * dw / np.sqrt(g.filters[k][o])
        at, grad = np.concatenate(rows), np.concatenate(grads)
        for source in (ids, ids2):
            bucket, back = np.unique(source[at], return_inverse=True)
            d = np.zeros((len(bucket), DIM))
            np.add.at(d, back, grad)
            d[bucket == pad] = 0
            g.embed[bucket] += (d**2).sum(1)
            m.embed[bucket] -= RATE * d / np.sqrt(g.embed[bucket])[:, None]
        g.out += d_out**2
        g.bias += d_bias**2
        g.shift += d_shift**2
        m.out -= RATE * d_out / np.sqrt(g.out)
        m.bias -= RATE * d_bias / np.sqrt(g.bias)
        m.shift -= RATE * d_shift / np.sqrt(g.shift)


def _best_cut(score: np.ndarray, y: np.ndarray, fallback: float, n: np.ndarray | None = None) -> float:
    """The threshold with the fewest errors; of equal ones that nearest the fallback. n: how often each score and kind occurs."""
    n = np.ones(len(score), np.int64) if n is None else n
    order, place = np.unique(score, return_inverse=True)
    cuts = np.r_[(order[1:] + order[:-1]) / 2, fallback]
    # of either kind, how many lie below each score
    below = [np.r_[0, np.cumsum(np.bincount(place, weights=n * (y == kind), minlength=len(order)))] for kind in (False, True)]
    at = np.searchsorted(order, cuts)
    errors = below[True][at] + below[False][-1] - below[False][at]
    best = cuts[errors == errors.min()]
    return float(best[np.argmin(np.abs(best - fallback))])


def calibrate(m: Model, words: list[np.ndarray], stems: list[np.ndarray], y: np.ndarray, lang: list[str | None]) -> None:
    """Moves the logit so that the cut with the fewest errors lies at 0.5, then sets thresholds by language."""
    if not 0 < y.sum() < len(y):
        return
    pooled = np.stack([m.pool(w, s) for w, s in zip(words, stems)])
    z = np.maximum(pooled + m.bias, 0) @ m.out + m.shift
    # the middle of the widest gap between kinds, weighed with the spread of both
    cut = _best_cut(z, y == 1, float((np.median(z[y == 1]) + np.median(z[y == 0])) / 2))
    m.moved = -m.scale * cut
    score = m.probability(pooled)
    for name in {x for x in lang if x}:
        own = np.array([x == name for x in lang])
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= LANGUAGE_ROWS:
            m.thresholds[name] = _best_cut(score[own], y[own] == 1, 0.5)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        both = [buckets(t) for t in texts]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "digest": pa.array([hashlib.sha1(encode(t)).digest() for t in texts], pa.binary()),
                "toxic": batch.column("toxic"),
                "lang": batch.column("lang"),
                "word": pa.array([w for w, _ in both], pa.list_(pa.int32())),
                "stem": pa.array([s for _, s in both], pa.list_(pa.int32())),
            }
        )


def _fitting(drawn: list[tuple[int, int]], sizes: dict[int, int], most: int) -> list[tuple[int, int]]:
    """The pairs of doc_id and label, in order, whose documents' bytes fit into what those before have left."""
    chosen = []
    for doc_id, toxic in drawn:
        if (size := sizes.get(doc_id, 0)) <= most:
            chosen.append((doc_id, toxic))
            most -= size
    return chosen


def fold(doc_id):
    """0 for held-out rows, 1 to 4 for those that may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of at most max_rows labels, the first by a hash of their id, and of these those whose whole texts fit into max_bytes; by the driver."""
    rows = _usable(labels)
    drawn = [tuple(r) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows).collect()]
    # at most max_rows pairs of numbers, so they can be broadcast whatever the tables' size
    table = lambda pairs: F.broadcast(docs.sparkSession.createDataFrame(pairs, "doc_id long, toxic int"))
    texts = _texts(docs, id_col, text_col, lang_col)
    # one scan of documents: sizes and texts are taken from the rows of the ids drawn, which are written
    with recorded() as worked:
        texts = materialise(texts.join(table([(i, 0) for i in {i for i, _ in drawn}]), "doc_id").drop("toxic"), "toxicity-drawn")
    # a row counts as LEAST_BYTES at least, so that max_bytes bounds rows too, however often an id is repeated
    size = F.sum(F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(LEAST_BYTES)).cast("long")).alias("size")
    sizes = texts.groupBy("doc_id").agg(size)
    chosen = _fitting(drawn, dict(map(tuple, sizes.collect())), max_bytes)
    joined = texts.join(table(chosen), "doc_id").select("doc_id", "toxic", "lang", "text")
    schema = "doc_id long, digest binary, toxic int, lang string, word array<int>, stem array<int>"
    # at most max_bytes of text, as 8 bytes a word; in an order of its own, so that the model is the same each time
    found = joined.mapInArrow(_train_rows, schema).toArrow().sort_by([(c, "ascending") for c in ("doc_id", "digest", "toxic", "lang")])
    drop(docs.sparkSession, worked)
    y = found["toxic"].to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return _constant(float(y.mean()) if len(y) else 0.0)
    arrays = [[np.asarray(v.values.to_numpy()) for v in found[c]] for c in ("word", "stem")]
    lang, held = found["lang"].to_pylist(), np.arange(len(y)) % FOLDS == 0
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False

    def part(mask):
        at = np.flatnonzero(mask)
        return [arrays[0][i] for i in at], [arrays[1][i] for i in at], y[at], [lang[i] for i in at]

    m = train(*part(~held)[:3], seed=seed)
    calibrate(m, *part(held if held.any() else ~held))
    m.embed = m.embed.astype(np.float32)
    m.filters = [w.astype(np.float32) for w in m.filters]
    return m


def _usable(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of labels that may be learned from."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return rows.filter("doc_id is not null and toxic in (0, 1)").filter(fold(F.col("doc_id")) != 0)


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))


BLOCKS = "block long, held binary, toxic binary, n binary, lang array<string>, ids binary"


def _pack(t: pa.Table) -> pa.Table:
    """One row of a block's rows, in an order of their own; of each row its words and then its stems, as four bytes each."""
    t = t.sort_by([(c, "ascending") for c in ("doc_id", "digest", "toxic", "lang")])
    n, ids = [], []
    for column in t["text"].chunks:
        for _, texts in slices(column):
            for word, stem in map(buckets, texts):
                n.append(len(word))
                ids += [word.tobytes(), stem.tobytes()]
    one = {"block": t["block"].to_numpy()[:1], "lang": pa.array([t["lang"].to_pylist()], pa.list_(pa.string())), "ids": pa.array([b"".join(ids)], pa.binary())}
    for c, kind, values in (("held", np.uint8, t["held"].to_pylist()), ("toxic", np.uint8, t["toxic"].to_pylist()), ("n", np.int64, n)):
        one[c] = pa.array([np.array(values, kind).tobytes()], pa.binary())
    return pa.table(one).select([c.split()[0] for c in BLOCKS.split(", ")])


@dataclass
class Block:
    number: int
    words: list[np.ndarray]
    stems: list[np.ndarray]
    y: np.ndarray
    held: np.ndarray
    lang: list[str | None]

    def take(self, mask: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        at = np.flatnonzero(mask)
        return [self.words[i] for i in at], [self.stems[i] for i in at], self.y[at]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    release()
    for batch in batches:
        for i in range(batch.num_rows):
            held, toxic, n = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("held", np.uint8), ("toxic", np.uint8), ("n", np.int64)))
            ids, end = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int32), 2 * np.cumsum(n)
            begin, middle = end - 2 * n, end - n
            cut = lambda a, b: [ids[x:y] for x, y in zip(a, b)]
            yield Block(batch.column("block")[i].as_py(), cut(begin, middle), cut(middle, end), toxic.astype(np.float64), held == 1, batch.column("lang")[i].as_py())


def write_blocks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(all labelled rows in blocks, how many there are by held and toxic).

    Rows that are alike in all are numbered, so that copies of one go to many blocks too; the merge join leaves them where they are numbered.
    """
    spark = docs.sparkSession
    rows = _texts(docs, id_col, text_col, lang_col).join(_usable(labels).hint("merge"), "doc_id").select("doc_id", "toxic", "lang", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    alike = ["doc_id", "digest", "toxic", "lang"]
    rows = rows.withColumn("place", F.xxhash64(*alike, F.row_number().over(Window.partitionBy(*alike).orderBy("doc_id"))))
    with recorded() as worked:
        rows = materialise(rows.withColumn("held", (F.pmod(F.xxhash64("place"), F.lit(FOLDS)) == 0).cast("int")), "toxicity-rows")
    collect_garbage(spark)  # nothing refers to the join any more
    size = F.greatest(F.octet_length("text"), F.lit(LEAST_BYTES)).cast("long")
    found = rows.groupBy("held", "toxic").agg(F.count("*"), F.sum(size)).collect()
    many = max(1, -(-sum(r[3] for r in found) // BLOCK_BYTES))
    blocks = materialise(rows.withColumn("block", F.pmod("place", F.lit(many))).drop("place").groupBy("block").applyInArrow(_pack, BLOCKS), "toxicity-blocks")
    drop(spark, worked)
    collect_garbage(spark)
    return blocks, {(r[0], r[1]): r[2] for r in found}


def _counter(all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, WORD_BUCKETS + STEM_BUCKETS), np.int64)
        for b in _blocks_of(batches):
            seen += _seen(*b.take(~b.held | all_rows))
        key = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int32()), "clean": pa.array(seen[0, key]), "toxic": pa.array(seen[1, key])})

    return run


def _dense(m: Model | Sums) -> np.ndarray:
    """All weights but those of buckets, end to end."""
    return np.concatenate([*(w.ravel() for w in m.filters), m.bias, m.out, [m.shift]])


def _set_dense(m: Model | Sums, values: np.ndarray) -> None:
    at = np.cumsum([0, *(w.size for w in m.filters), m.bias.size, m.out.size])
    m.filters = [values[a:b].reshape(w.shape).copy() for w, a, b in zip(m.filters, at, at[1:])]
    k = len(m.filters)
    m.bias, m.out, m.shift = values[at[k] : at[k + 1]].copy(), values[at[k + 1] : at[k + 2]].copy(), float(values[-1])


#: Of each weight, or row of them by bucket: what it moved by and, last, what its sum of squares grew by, added up over n blocks.
MOVED = ", ".join(["key int", "n long", *(f"v{i} long" for i in range(DIM + 1))])


def _mover(shared, epoch: int, seed: int, all_rows: bool, weights: tuple[float, float]):
    """An epoch of each block from the shared model, and what it moved; blocks of a task are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, sums = shared.value
        rows, flat, flat_sums = len(start.embed), _dense(start), _dense(sums)
        moved, n = np.zeros((rows + len(flat), DIM + 1), np.int64), np.zeros(rows + len(flat), np.int64)
        for b in _blocks_of(batches):
            words, stems, y = b.take(~b.held | all_rows)
            if not len(y):
                continue
            m = Model(start.embed.astype(np.float64), [w.copy() for w in start.filters], start.bias.copy(), start.out.copy(), start.shift)
            g = Sums(sums.embed.astype(np.float64), [w.copy() for w in sums.filters], sums.bias.copy(), sums.out.copy(), sums.shift)
            _epoch(m, g, words, stems, y, np.where(y == 1, weights[1], weights[0]), np.random.default_rng([seed, epoch, b.number]))
            at = np.flatnonzero(g.embed != sums.embed)
            moved[at, :DIM] += np.rint((m.embed[at] - start.embed[at]) / GRAIN).astype(np.int64)
            moved[at, DIM] += np.rint((g.embed[at] - sums.embed[at]) / GRAIN).astype(np.int64)
            moved[rows:, 0] += np.rint((_dense(m) - flat) / GRAIN).astype(np.int64)
            moved[rows:, DIM] += np.rint((_dense(g) - flat_sums) / GRAIN).astype(np.int64)
            n[at] += 1
            n[rows:] += 1
        key = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int32()), "n": pa.array(n[key]), **{f"v{i}": pa.array(moved[key, i]) for i in range(DIM + 1)}})

    return run


def _advance(blocks: DataFrame, m: Model, g: Sums, epoch: int, seed: int, all_rows: bool, weights: tuple[float, float]) -> None:
    """One epoch over all blocks; the driver gets at most a row a weight."""
    shared = blocks.sparkSession.sparkContext.broadcast((m, g))
    columns = [f"v{i}" for i in range(DIM + 1)]
    moved = blocks.mapInArrow(_mover(shared, epoch, seed, all_rows, weights), MOVED)
    found = moved.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", *columns)]).toArrow()
    shared.destroy()
    key, n = found["key"].to_numpy(), found["n"].to_numpy()
    mean = np.stack([found[c].to_numpy() for c in columns], axis=1) * (GRAIN / n)[:, None]
    rows = len(m.embed)
    own = key < rows
    # whole numbers of GRAIN and float32 on, so that the broadcast is small
    m.embed[key[own]] += mean[own, :DIM].astype(np.float32)
    g.embed[key[own]] += mean[own, DIM].astype(np.float32)
    for part, column in ((m, 0), (g, DIM)):
        flat = _dense(part)
        flat[key[~own] - rows] += mean[~own, column]
        _set_dense(part, flat)


def _judge(shared, held_only: bool):
    """Language, label and logit in steps of 1 / BINS of each row that calibrates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in _blocks_of(batches):
            at = np.flatnonzero(b.held | (not held_only))
            pooled = np.stack([m.pool(b.words[i], b.stems[i]) for i in at]) if len(at) else np.zeros((0, FILTERS * len(WIDTHS)))
            z = np.maximum(pooled + m.bias, 0) @ m.out + m.shift
            bins = np.rint(np.clip(z, -30, 30) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([b.lang[i] for i in at], pa.string()), "toxic": pa.array(b.y[at].astype(np.int32)), "bin": pa.array(bins)})

    return run


def _middle(score: np.ndarray, n: np.ndarray) -> float:
    """The median of scores that occur n times each."""
    order = np.argsort(score)
    return float(score[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])


def _calibrate_blocks(blocks: DataFrame, m: Model, held_only: bool) -> None:
    """As calibrate(), by counts of all rows that calibrate; the driver gets a row a step and kind, and one a language."""
    shared = blocks.sparkSession.sparkContext.broadcast(m)
    with recorded() as worked:
        tally = materialise(blocks.mapInArrow(_judge(shared, held_only), "lang string, toxic int, bin int").groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n")), "toxicity-tally")
    shared.destroy()
    total = tally.groupBy("toxic", "bin").agg(F.sum("n").alias("n")).toArrow().sort_by([("bin", "ascending"), ("toxic", "ascending")])
    y, z, n = total["toxic"].to_numpy() == 1, total["bin"].to_numpy() / BINS, total["n"].to_numpy()
    cut = _best_cut(z, y, (_middle(z[y], n[y]) + _middle(z[~y], n[~y])) / 2, n)
    m.moved = -m.scale * cut

    def own(t: pa.Table) -> pa.Table:
        z = t["bin"].to_numpy() / BINS - cut
        return pa.table({"lang": t["lang"].slice(0, 1), "cut": pa.array([_best_cut(z, t["toxic"].to_numpy() == 1, 0.0, t["n"].to_numpy())])})

    count = lambda kind: F.sum(F.when(F.col("toxic") == kind, F.col("n")).otherwise(0)) >= LANGUAGE_ROWS
    enough = tally.filter("lang <> ''").groupBy("lang").agg(count(0).alias("_clean"), count(1).alias("_toxic")).filter("_clean and _toxic").select("lang")
    cuts = tally.join(enough, "lang", "left_semi").groupBy("lang").applyInArrow(own, "lang string, cut double").collect()
    m.thresholds = {r["lang"]: float(1 / (1 + np.exp(-r["cut"]))) for r in cuts}
    drop(blocks.sparkSession, worked)


def _constant(share: float) -> Model:
    m = Model(np.zeros((1, DIM)), [np.zeros((w, DIM, FILTERS)) for w in WIDTHS], np.zeros(0), np.zeros(0))
    m.constant = share
    return m


def fit(docs: DataFrame, labels: DataFrame, max_rows: int | None = None, max_bytes: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the labels (doc_id, toxic) of docs: of all that may be learned from, unless the caller asks for less."""
    if max_rows is not None or max_bytes is not None:
        most = 2**31 - 1
        return fit_sample(docs, labels, most if max_rows is None else max_rows, most if max_bytes is None else max_bytes, seed, id_col, text_col, lang_col)
    with recorded() as worked:
        blocks, found = write_blocks(docs, labels, id_col, text_col, lang_col)
    kinds = lambda held: [sum(found.get((h, t), 0) for h in held) for t in (0, 1)]
    every = kinds((0, 1))
    if not all(every):
        drop(docs.sparkSession, worked)
        return _constant(every[1] / sum(every) if sum(every) else 0.0)
    # rows are held back only where both kinds are left to learn from
    all_rows = not all(kinds((0,)))
    neg, pos = every if all_rows else kinds((0,))
    seen = np.zeros((2, WORD_BUCKETS + STEM_BUCKETS), np.int64)
    counts = blocks.mapInArrow(_counter(all_rows), "key int, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    for label, c in enumerate(("clean", "toxic")):
        seen[label, counts["key"].to_numpy()] = counts[c].to_numpy()
    m = _start(seen, pos, neg, np.random.default_rng(seed))
    g = Sums.of(m)
    m.embed, g.embed = m.embed.astype(np.float32), g.embed.astype(np.float32)
    for epoch in range(EPOCHS):
        _advance(blocks, m, g, epoch, seed, all_rows, _weights(pos, neg))
    m.filters = [w.astype(np.float32) for w in m.filters]
    _calibrate_blocks(blocks, m, not all_rows and all(kinds((1,))))
    drop(docs.sparkSession, worked)
    return m


def _scorer(shared, keep: bool, text_col: str = "text", lang_col: str = "lang"):
    """keep: pass on the whole rows that are not flagged, else give a row of SCORES for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m: Model = shared.value
        for batch in batches:
            if m.constant is not None:
                score = np.full(batch.num_rows, m.constant)
            else:
                score = np.concatenate([np.zeros(0), *(m.probability(m.pools(texts)) for _, texts in slices(batch.column(text_col)))])
            threshold = np.array([m.thresholds.get(x, 0.5) for x in batch.column(lang_col).cast(pa.string()).to_pylist()])
            if keep:
                yield batch.filter(pa.array(score < threshold))
                continue
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "score": pa.array(score, pa.float64()),
                    "predicted": pa.array((score >= 0.5).astype(np.int32)),
                    "threshold": pa.array(threshold, pa.float64()),
                    "flagged": pa.array((score >= threshold).astype(np.int32)),
                }
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted, threshold (of the row's language), flagged of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(fold(F.col(id_col).cast("long")) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(_scorer(shared, False), SCORES)


def clean(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold of their language."""
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), True, text_col, lang_col), docs.schema)
