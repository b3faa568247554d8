"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Words are counted in Spark and numbered by frequency. Blocks of texts ask buckets of the hash space for the numbers of their words, one
row each way, and, so coded, send every shard the distinct word triples
that it owns with their counts; a shard merges them to a trie of three levels. A level holds the words of its nodes, made monotone by
adding what the contexts before took up; monotone pointers cut it to the children of each context; each node holds its quantised
share of the smoothed probability. All are Elias-Fano sequences or packed integers in one file a shard in the shared folder, which tasks
map into memory. A query looks up its first word, then in the range of each context the successor of the next word: what lies
there either is the word or shows that it was never seen there.

The model is the hierarchical Dirichlet language model of MacKay and Peto: with c(..) the counts in the training texts and K2, K3
the weights of the shorter context,

    p1(z) = (c(z) + 0.1) / (N + 0.1 (V + 1))
    p2(z | y) = c(y z) / (c(y) + K2) + K2 / (c(y) + K2) p1(z)
    p3(z | x y) = c(x y z) / (c(x y) + K3) + K3 / (c(x y) + K3) p2(z | y)

Each first summand is kept as the nearest multiple of 1 / STEP of its common logarithm; the weight K3 / (c(x y) + K3) takes c(x y) from
the share that the pair (x, y) has. A text is a beginning, its words
and one end; the first word has the beginning alone for a context, and every word and the end are scored.

Shards are chosen by a hash of the first two words, so their size follows the number of triples; two words that are both so frequent
that their pair could overfill a shard are dealt by the third word too, and their own count is asked for beforehand. Rows between
blocks and shards hold what a block has for a shard, so there are never more of them than distinct triples in blocks. Nothing
that grows with the corpus goes through the driver or a broadcast.

Defined results: words are the runs without \\x20 and \\x09-\\x0D, A-Z lower-cased; null and empty texts are one end; a null doc_id counts as the
empty text in the split, so its row is held out; rows with repeated ids are rows of their own; very long texts are blocks of their
own; without training texts every token has probability 1 in the base and in the model; an empty table gives no rows. Words are told
apart by 64-bit hashes. Only the id and text columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ASKED, MIN_KEYS, Plan, _sender, ask_keys, in_order, join_blobs, planes, split_blobs, unplanes
from .eliasfano import Monotone, Packed, Reader, Writer, write_monotone, write_packed
from .resident import release
from .scratch import collect_garbage, drop, make_dir, materialise, new_path, path_of, recorded
from .tokencount import slices
from .words import encode, hashes, lower_ascii, mix, spans

#: Weights of the shorter context, and steps of a quantised logarithm to a factor of ten.
K2, K3, STEP = 500.0, 4.0, 128
#: Added to each count of the base.
ADDED = 0.1
BLOCK_BYTES = 4 << 20
#: Triples of a shard, about, and occurrences of a pair that go to one shard.
SHARD_TRIPLES, SHARD_PAIR = 1 << 20, 1 << 20
#: Numbers of what is no word, before those of words; a word not seen in training is UNKNOWN.
BEGIN, END, PAD, UNKNOWN, WORDS = 0, 1, 2, 3, 4
#: Words hashed at a time.
_HASHED = 1 << 17
#: Code of a node that is not there.
NONE = np.uint16(2**16 - 1)

BLOCKS = "words long, learned_docs long, learned_tokens long, payload binary"
CODED = "block_id long, payload binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column, parts: int = 10) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


# --- blocks ---------------------------------------------------------------------------------------------------------------


def _pack(ids: list[int | None], learn: list[bool], texts: list[bytes]) -> pa.RecordBatch:
    text = b" ".join(texts) + b" "
    size = np.array([len(t) + 1 for t in texts], np.int64)
    start, end = spans(text)
    first = np.searchsorted(start, np.r_[0, np.cumsum(size)])
    each = [hashes(text, start[i : i + _HASHED], end[i : i + _HASHED]) for i in range(0, len(start), _HASHED)]
    word, place = np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_inverse=True)
    lengths, learned = np.diff(first), np.array(learn, bool)
    # the most frequent first, so that their places are small
    order = np.argsort(-np.bincount(place, minlength=len(word)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word, place = word[order], rank[place]
    count = np.bincount(place[np.repeat(learned, lengths)], minlength=len(word))
    parts = [np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), learned.astype(np.uint8), lengths, word, count.astype(np.uint32), place.astype(np.uint32)]
    return pa.RecordBatch.from_pydict(
        {
            "words": pa.array([len(word)], pa.int64()),
            "learned_docs": pa.array([int(learned.sum())], pa.int64()),
            "learned_tokens": pa.array([int(lengths[learned].sum() + learned.sum())], pa.int64()),
            "payload": pa.array([join_blobs([planes(p) for p in parts])], pa.binary()),
        }
    )


def write_blocks(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block_id, payload and counts: texts as places in the block's own words. `learn` says of each row whether the model may learn from it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ids, learns, texts, size = [], [], [], 0
        for batch in batches:
            batch_ids, batch_learn = batch.column("doc_id").to_pylist(), batch.column("learn").to_pylist()
            for begin, part in slices(batch.column("text")):
                for i, t in enumerate(part, begin):
                    ids.append(batch_ids[i])
                    learns.append(bool(batch_learn[i]))
                    texts.append(lower_ascii(encode(t)))
                    size += len(texts[-1]) + 1
                    if size >= block_bytes:
                        yield _pack(ids, learns, texts)
                        ids, learns, texts, size = [], [], [], 0
        if ids:
            yield _pack(ids, learns, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learn.alias("learn"))
    return materialise(rows.mapInArrow(pack, BLOCKS).withColumn("block_id", F.monotonically_increasing_id()), "lm-blocks")


# --- words ----------------------------------------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Words seen in training: a table of hash, count and number (the most frequent first), and what they add up to."""

    words: DataFrame
    docs: int
    tokens: int
    distinct: int
    #: Count of the second most frequent word.
    second: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + ADDED) / (self.tokens + ADDED * (self.distinct + 1))


BLOCK_WORDS = "hash long, n long"
WORD_LISTS = "block_id long, payload binary"


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column("payload"):
            parts = split_blobs(payload.as_py())
            word, count = unplanes(parts[4]), unplanes(parts[5])
            learned = count > 0
            yield pa.RecordBatch.from_pydict({"hash": pa.array(word[learned].view(np.int64)), "n": pa.array(count[learned].astype(np.int64))})


def learn_words(blocks: DataFrame) -> Vocabulary:
    words = blocks.select("payload").mapInArrow(_block_words, BLOCK_WORDS)
    words = words.groupBy("hash").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "hash")
    words = materialise(words.withColumn("number", F.monotonically_increasing_id() + WORDS), "lm-words")
    docs, tokens = blocks.agg(F.sum("learned_docs"), F.sum("learned_tokens")).first()
    top = [r[0] for r in words.select("count").orderBy(F.desc("count")).limit(2).collect()]
    return Vocabulary(words, docs or 0, tokens or 0, words.count() + bool(docs), top[1] if len(top) > 1 else 0)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads with texts as places in the block's known words, these sorted by number."""
    for row in _each(batches):
        ids, null, learned, lengths, word, _, seq = split_blobs(row["payload"])
        by_hash = np.argsort(unplanes(word))
        answers = [list(map(unplanes, split_blobs(b))) for b in in_order(row["answers"])]
        number, count = (np.concatenate([np.zeros(0, np.uint64), *[a[i] for a in answers]]).astype(np.int64) for i in (0, 1))
        order = np.argsort(number)
        order = order[np.searchsorted(number[order], 1) :]  # a word that was not seen in training has no number
        rank = np.full(by_hash.shape, UNKNOWN, np.uint32)
        rank[by_hash[order]] = WORDS + np.arange(len(order))
        seq = rank[unplanes(seq)] if len(rank) else rank
        payload = join_blobs([ids, null, learned, lengths, planes(np.diff(number[order].astype(np.uint64), prepend=np.uint64(0))), planes(count[order]), planes(seq)])
        yield pa.RecordBatch.from_pydict({"block_id": pa.array([row["block_id"]], pa.int64()), "payload": pa.array([payload], pa.binary())})


def _word_list(table: pa.Table) -> pa.Table:
    """Words of a bucket in one row, by hash; its block_id is below 0, as those of blocks are not."""
    word = table["hash"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    payload = join_blobs([planes(v[order]) for v in (word, _narrow(table["number"].to_numpy()), _narrow(table["count"].to_numpy()))])
    return pa.table({"block_id": pa.array([-1 - table["bucket"][0].as_py()], pa.int64()), "payload": pa.array([payload], pa.binary())})


def _word_question(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a list of words: these with their numbers and counts; of a block: its words, with nothing to add to those."""
    parts = split_blobs(row["payload"])
    if row["block_id"] < 0:
        word, number, count = map(unplanes, parts)
        return word, [number, count]
    word = np.sort(unplanes(parts[4]))
    return word, [np.zeros(len(word), np.uint8)] * 2


def code(blocks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """block_id and payload, with words as the vocabulary numbers them."""
    spark = blocks.sparkSession
    words, count = blocks.agg(F.sum("words"), F.count("*")).first()
    words = words or 0
    # no more buckets for the sake of partitions than rows of MIN_KEYS words bear
    plan = Plan(words, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, words // max(1, count) // (4 * MIN_KEYS))), count)
    plan.bits = 64
    # as plan.bucket() has it, so that a list of words goes to one bucket
    top = 63 - plan.buckets.bit_length()
    bucket = F.shiftright(F.shiftrightunsigned("hash", 64 - top) * F.lit(plan.buckets), top)
    lists = vocabulary.words.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_word_list, WORD_LISTS)
    with recorded() as worked:
        asked = ask_keys(blocks.select("block_id", "payload").union(lists), plan, _word_question, ["sum", "sum"], lambda values: list(map(_narrow, values)))
        answers = materialise(asked.filter("block_id >= 0"), "lm-numbers")  # not those to lists of words
    del asked
    drop(spark, [p for p in worked if "lm-numbers" not in p])
    collect_garbage(spark)  # what blocks asked, before their payloads are shuffled
    out = materialise(blocks.select("block_id", "payload").join(answers, "block_id", "left").mapInArrow(_code, CODED), "lm-coded")
    drop(spark, [p for p in worked if "lm-numbers" in p])
    return out


class Coded:
    """A block's texts as symbols, each with beginning, end and padding, and their triples.

    Pairs and triples are distinct and sorted by the numbers of their words. `pair_of` is the pair of each triple.
    """

    def __init__(self, payload: bytes, vocabulary_docs: int, learned_only: bool = False):
        ids, null, learned, lengths, number, count, seq = (unplanes(p) for p in split_blobs(payload))
        number = np.cumsum(number, dtype=np.uint64)
        self.ids, self.null, self.learned = ids, null.astype(bool), learned.astype(bool)
        if learned_only:
            seq, lengths, self.learned = seq[np.repeat(self.learned, lengths)], lengths[self.learned], self.learned[self.learned]
        self.number = np.r_[np.arange(WORDS, dtype=np.uint64), number]
        self.count = np.r_[np.array([vocabulary_docs, vocabulary_docs, 0, 0]), count]
        self.lengths = lengths
        stop = np.cumsum(lengths + 3)
        self.first = stop - lengths - 3
        symbols = np.full(stop[-1] if len(stop) else 0, PAD, np.int64)
        symbols[self.first], symbols[stop - 2] = BEGIN, END
        inner = np.ones(len(symbols), bool)
        inner[self.first] = inner[stop - 2] = inner[stop - 1] = False
        symbols[inner] = seq
        self.symbols = symbols
        at = np.ones(len(symbols), bool)
        at[stop - 2] = at[stop - 1] = False
        self.at = np.flatnonzero(at)

    def triples(self, of: np.ndarray | None = None) -> None:
        """Sorts the triples whose first two words are known, or among `of` (by symbol); of the others nothing is asked."""
        s = self.symbols
        of = np.arange(len(self.number)) != UNKNOWN if of is None else of
        self.asked = self.at[of[s[self.at]] & of[s[self.at + 1]]]
        pairs, pair = np.unique((s[self.asked] << 32) | s[self.asked + 1], return_inverse=True)
        self.x, self.y = pairs >> 32, pairs & (2**32 - 1)
        triples, self.triple = np.unique((pair << 32) | s[self.asked + 2], return_inverse=True)
        self.pair_of, self.z = triples >> 32, triples & (2**32 - 1)
        # occurrences in the texts that may be learned from
        learned = np.repeat(self.learned, self.lengths + 3)[self.asked]
        self.times = np.bincount(self.triple[learned], minlength=len(triples))
        self.pair_times = np.bincount(self.pair_of, self.times, len(pairs)).astype(np.int64)


@dataclass
class Routes:
    """Which shard a triple belongs to."""

    shards: int
    pair_limit: int = SHARD_PAIR

    def salts(self, c: Coded) -> np.ndarray:
        """Over how many shards each pair's triples are dealt: no more than its words allow it occurrences."""
        return np.maximum(1, -(-np.minimum(c.count[c.x], c.count[c.y]) // self.pair_limit))

    def pair_key(self, c: Coded, pairs: np.ndarray) -> np.ndarray:
        return mix(mix(c.number[c.x[pairs]]) + c.number[c.y[pairs]])

    def cut(self, c: Coded) -> Iterator[tuple[int, np.ndarray]]:
        """Shards with the triples for each, in order. Pairs that are dealt have a triple with PAD, which holds their own figures; see with_homes()."""
        salts = self.salts(c)[c.pair_of].astype(np.uint64)
        key = self.pair_key(c, c.pair_of)
        many = np.flatnonzero(salts > 1)
        key[many] = mix(key[many] + np.uint64(1) + mix(c.number[c.z[many]]) % salts[many])
        shard = ((key >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)
        # two bytes are sorted by their digits, in time of the triples
        order = np.argsort(shard.astype(np.uint16) if self.shards <= 2**16 else shard, kind="stable")
        at = np.flatnonzero(np.diff(shard[order], prepend=-1)) if len(order) else order
        for a, b in zip(at, np.r_[at[1:], len(order)]):
            yield int(shard[order[a]]), order[a:b]

    def with_homes(self, c: Coded) -> None:
        """Adds (pair, PAD) for each pair that is dealt over shards, where the text has none; it stands for no occurrence."""
        dealt = np.flatnonzero(self.salts(c) > 1)
        have = c.pair_of[c.z == PAD]
        dealt = dealt[~np.isin(dealt, have)]
        if len(dealt):
            key = np.r_[(c.pair_of << 32) | c.z, (dealt << 32) | PAD]
            order = np.argsort(key)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            c.triple = place[c.triple]
            c.times = np.r_[c.times, np.zeros(len(dealt), c.times.dtype)][order]
            c.pair_of, c.z = key[order] >> 32, key[order] & (2**32 - 1)


def _message(c: Coded, at: np.ndarray, more: list[np.ndarray]) -> bytes:
    """Triples of a block for a shard: each pair once, how many triples it has here, and their last words; `more` lists values of pairs of the block."""
    pair = c.pair_of[at]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    own = pair[first]
    n = np.diff(np.r_[first, len(pair)]).astype(np.uint32)
    return join_blobs([planes(_narrow(v)) for v in (c.number[c.x[own]], c.number[c.y[own]], n, c.number[c.z[at]], *[m[own] for m in more])])


def _narrow(values: np.ndarray) -> np.ndarray:
    """As unsigned integers of four bytes where they fit."""
    values = values.astype(np.uint64)
    return values.astype(np.uint32) if not len(values) or values.max() < 2**32 else values


# --- trie -----------------------------------------------------------------------------------------------------------------


def quantise(p: np.ndarray) -> np.ndarray:
    """Of probabilities above 0: the common logarithm in steps of 1 / STEP, negated."""
    return np.minimum(np.rint(-np.log10(p) * STEP), int(NONE) - 1).astype(np.uint16)


_VALUES = np.r_[10.0 ** (-np.arange(int(NONE)) / STEP), 0.0]


def _write_children(w: Writer, name: str, context: np.ndarray, word: np.ndarray, contexts: int) -> None:
    """A level: nodes sorted by context and word. The words of a context follow on from the last word of the context before."""
    pointer = np.searchsorted(context, np.arange(contexts + 1)).astype(np.uint64)
    last = pointer[1:].astype(np.int64) - 1
    base = np.zeros(contexts, np.uint64)
    np.cumsum(word[last[:-1]] + np.uint64(1), out=base[1:])
    write_monotone(w, f"{name}.pointers", pointer)
    write_monotone(w, f"{name}.words", base[context] + word)


def build_trie(x: np.ndarray, y: np.ndarray, pair_of: np.ndarray, z: np.ndarray, times: np.ndarray, count_x: np.ndarray, count_xy: np.ndarray) -> bytes:
    """A trie of sorted distinct pairs (x, y), each with some triple, and their sorted distinct triples.

    count_x and count_xy are those of a pair's contexts in all training texts; times those of a triple, 0 for one that only keeps its pair.
    """
    w = Writer()
    roots, root_of = np.unique(x, return_inverse=True)
    write_monotone(w, "roots", roots)
    _write_children(w, "second", root_of, y, len(roots))
    write_packed(w, "second.share", quantise(count_xy / (count_x + K2)))
    _write_children(w, "third", pair_of, z, len(y))
    share = times / (count_xy[pair_of] + K3)
    code = np.full(len(times), NONE)
    code[times > 0] = quantise(share[times > 0])
    write_packed(w, "third.share", code)
    return w.to_bytes()


class Level:
    """Children of contexts: their range by pointers, in it a word by successor search."""

    def __init__(self, r: Reader, name: str):
        self.pointers, self.words = Monotone(r, f"{name}.pointers"), Monotone(r, f"{name}.words")

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of each context end, and what their words follow on from."""
        begin, end = (p.astype(np.int64) for p in self.pointers.pairs(context))
        base = np.where(begin > 0, self.words[np.maximum(begin, 1) - 1] + np.uint64(1), np.uint64(0)) if len(begin) else np.zeros(0, np.uint64)
        return end, base

    def find(self, end: np.ndarray, base: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node of each word among the children so described, -1 where it is none."""
        at, equal = self.words.successor(base + word)
        return np.where(equal & (at < end), at, -1)


class Trie:
    def __init__(self, buffer):
        r = Reader(buffer)
        self.roots, self.second, self.third = Monotone(r, "roots"), Level(r, "second"), Level(r, "third")
        self.share2, self.share3 = Packed(r, "second.share"), Packed(r, "third.share")

    def look_up(self, x: np.ndarray, y: np.ndarray, pair_of: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the share of each pair, and of each triple (pair_of, z); NONE where there is no node."""
        share2, share3 = (np.full(n, NONE) for n in (len(x), len(z)))
        new = np.diff(x, prepend=~x[:1]) != 0  # pairs lie sorted, mostly
        first, of = x[new], np.cumsum(new) - 1
        root, there = self.roots.successor(first)
        end, base = np.zeros(len(first), np.int64), np.zeros(len(first), np.uint64)
        some = np.flatnonzero(there)
        end[some], base[some] = self.second.ranges(root[some])
        node = self.second.find(end[of], base[of], y)
        some = np.flatnonzero(node >= 0)
        share2[some] = self.share2[node[some]]
        end, base = np.zeros(len(x), np.int64), np.zeros(len(x), np.uint64)
        end[some], base[some] = self.third.ranges(node[some])
        some = np.flatnonzero(node[pair_of] >= 0)
        leaf = self.third.find(end[pair_of[some]], base[pair_of[some]], z[some])
        some, leaf = some[leaf >= 0], leaf[leaf >= 0]
        share3[some] = self.share3[leaf]
        return share2, share3


def _map(path: str):
    """The bytes of a file: a memory map where the shared folder is a local path, else one read."""
    fs, root = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(root).read_buffer()
    with fs.open_input_file(root) as f:
        return f.read_buffer(f.size())


# --- learning -------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    vocabulary: Vocabulary
    routes: Routes
    #: shard, path, bytes and nodes of each trie.
    shards: DataFrame


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _hot_pairs(coded: DataFrame, vocabulary: Vocabulary, routes: Routes, learned_only: bool) -> DataFrame:
    """block_id and counts (of all training texts, in order) of the pairs of each block that are dealt over shards."""

    def question(row: dict):
        c = Coded(row["payload"], vocabulary_docs, learned_only)
        c.triples(c.count > routes.pair_limit)
        dealt = np.flatnonzero(routes.salts(c) > 1)
        key = routes.pair_key(c, dealt)
        order = np.argsort(key)
        return key[order], [c.pair_times[dealt][order]]

    vocabulary_docs = vocabulary.docs
    spark = coded.sparkSession
    plan = Plan(vocabulary.tokens, int(spark.conf.get("spark.sql.shuffle.partitions")), coded.count())
    plan.bits = 64
    return ask_keys(coded, plan, question, ["sum"], lambda values: values).withColumnRenamed("answers", "hot")


def _count_message(routes: Routes, docs: int, learned_only: bool):
    def question(row: dict) -> Iterator[tuple[int, bytes]]:
        c = Coded(row["payload"], docs, learned_only)
        c.triples()
        routes.with_homes(c)
        stated = np.zeros(len(c.x), np.uint64)
        if row.get("hot"):
            dealt = np.flatnonzero(routes.salts(c) > 1)
            order = np.argsort(routes.pair_key(c, dealt))
            stated[dealt[order]] = np.concatenate([unplanes(split_blobs(b)[0]) for b in in_order(row["hot"])])
        more = [c.count[c.x], stated]
        for shard, at in routes.cut(c):
            yield shard, join_blobs([_message(c, at, more), planes(_narrow(c.times[at]))])

    return question


def _merge(blobs: list[bytes]) -> tuple[tuple[np.ndarray, ...], list[tuple[np.ndarray, np.ndarray]]]:
    """x, y, pair_of, z, times, count_x, count_xy of all blocks' messages to a shard, and of each message where its pairs and triples are among these."""
    messages, times = zip(*(split_blobs(b) for b in blobs))
    parts = [[unplanes(p) for p in split_blobs(m)] for m in messages]
    x, y, n, z, count_x, stated = (np.concatenate([p[i] for p in parts]) for i in range(6))
    times = np.concatenate([unplanes(t) for t in times]).astype(np.int64)
    # numbers mostly fit into four bytes, so that pairs and triples sort as one integer each
    small = max(int(v.max()) for v in (x, y)) < 2**31
    order = np.argsort((x.astype(np.int64) << 32) | y.astype(np.int64)) if small else np.lexsort((y, x))
    new = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]
    pair = np.empty(len(x), np.int64)
    pair[order] = np.cumsum(new) - 1
    lead = order[new]
    words, z = (None, z.astype(np.int64)) if int(z.max()) < 2**32 else np.unique(z, return_inverse=True)
    key = (np.repeat(pair, n) << 32) | z
    order = np.argsort(key)
    key = key[order]
    new = np.diff(key, prepend=-1) != 0
    first, place = np.flatnonzero(new), np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    cuts = [np.cumsum([len(p[i]) for p in parts])[:-1] for i in (0, 3)]
    places = list(zip(np.split(pair, cuts[0]), np.split(place, cuts[1])))
    times = np.add.reduceat(times[order], first)
    pair_of = key[first] >> 32
    seen = np.bincount(pair_of, times, len(lead))
    count_xy = np.where(stated[lead] > 0, stated[lead], seen)
    z = key[first] & (2**32 - 1)
    z = z.astype(np.uint64) if words is None else words[z].astype(np.uint64)
    return (x[lead].astype(np.uint64), y[lead].astype(np.uint64), pair_of, z, times, count_x[lead].astype(np.float64), count_xy.astype(np.float64)), places


def _learned(merged: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Without the triples that no text to learn from has, but for those that keep a pair, and without pairs that none has."""
    x, y, pair_of, z, times, count_x, count_xy = merged
    kept = np.flatnonzero((times > 0) | ((z == PAD) & (count_xy[pair_of] > 0)))
    pairs, pair_of = np.unique(pair_of[kept], return_inverse=True)
    return x[pairs], y[pairs], pair_of, z[kept], times[kept], count_x[pairs], count_xy[pairs]


def _look_up_all(trie: Trie, x: np.ndarray, y: np.ndarray, pair_of: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As look_up of pairs and triples in order, about _LOOKED_UP triples at a time."""
    share2, share3, at = [], [], 0
    while at < len(z):
        upto = int(np.searchsorted(pair_of, pair_of[min(at + _LOOKED_UP, len(z)) - 1], side="right"))
        first, last = int(pair_of[at]), int(pair_of[upto - 1]) + 1
        codes = trie.look_up(x[first:last], y[first:last], pair_of[at:upto] - first, z[at:upto])
        share2.append(codes[0])
        share3.append(codes[1])
        at = upto
    return np.concatenate(share2), np.concatenate(share3)


#: Triples looked up at a time.
_LOOKED_UP = 1 << 18


def _shard_writer(folder: str, keep: bool = True):
    def put(shard: int, merged: tuple[np.ndarray, ...]) -> pa.Table:
        learned = _learned(merged)
        data = build_trie(*learned)
        fs, root = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        # a name of the attempt's own: the table lists those of tasks that succeeded
        name = f"shard-{shard:08d}-{context.taskAttemptId() if context else uuid.uuid4().hex}.trie"
        with fs.open_output_stream(f"{root}/.{name}.part", compression=None) as out:
            out.write(data)
        fs.move(f"{root}/.{name}.part", f"{root}/{name}")
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "bytes": pa.array([len(data)], pa.int64()), "nodes": pa.array([len(learned[3])], pa.int64())})

    def write(table: pa.Table) -> pa.Table:
        return put(table["bucket"][0].as_py(), _merge(table["blob"].to_pylist())[0])

    def write_and_answer(table: pa.Table) -> pa.Table:
        """The shard's row, and rows of answers to the blocks that sent the counts, each triple looked up once. A shard that is not kept goes when it has answered."""
        merged, places = _merge(table["blob"].to_pylist())
        written = put(table["bucket"][0].as_py(), merged)
        path = written["path"][0].as_py()
        share2, share3 = _look_up_all(Trie(_map(path)), *merged[:4])
        if not keep:
            fs, root = pafs.FileSystem.from_uri(path)
            fs.delete_file(root)
        blobs = [join_blobs([planes(share2[p]), planes(share3[t])]) for p, t in places]
        answers = pa.table({"bucket": table["bucket"], "block_id": table["block_id"], "blob": pa.array(blobs, pa.binary())})
        return pa.concat_tables([written, answers], promote_options="default").select(list(WRITTEN_NAMES))

    return write, write_and_answer


WRITTEN = "shard int, path string, bytes long, nodes long"
WRITTEN_NAMES = ("shard", "path", "bytes", "nodes", "bucket", "block_id", "blob")


def learn_and_answer(coded: DataFrame, vocabulary: Vocabulary, shard_triples: int = SHARD_TRIPLES, pair_limit: int = SHARD_PAIR, keep: bool = True) -> tuple[Model, DataFrame]:
    """A model, and what it says to the blocks it was learned from, which then need not ask again: (bucket, block_id, blob).

    Blocks send the triples of all their texts; those of held-out texts alone count as none. Without `keep` the model's shards are gone afterwards.
    """
    rows, routes, folder = _counting(coded, vocabulary, shard_triples, pair_limit, learned_only=False)
    sent = rows.mapInArrow(_sender(_count_message(routes, vocabulary.docs, False)), ASKED)
    made = materialise(sent.groupBy("bucket").applyInArrow(_shard_writer(folder, keep)[1], f"{WRITTEN}, {ASKED}"), "lm-made")
    del sent
    collect_garbage(coded.sparkSession)  # what blocks sent
    return Model(vocabulary, routes, made.filter("shard is not null").select("shard", "path", "bytes", "nodes")), made.filter("shard is null").select("bucket", "block_id", "blob")


def learn_ngrams(coded: DataFrame, vocabulary: Vocabulary, shard_triples: int = SHARD_TRIPLES, pair_limit: int = SHARD_PAIR) -> Model:
    rows, routes, folder = _counting(coded, vocabulary, shard_triples, pair_limit, learned_only=True)
    sent = rows.mapInArrow(_sender(_count_message(routes, vocabulary.docs, True)), ASKED)
    return Model(vocabulary, routes, materialise(sent.groupBy("bucket").applyInArrow(_shard_writer(folder)[0], WRITTEN), "lm-manifest"))


def _counting(coded: DataFrame, vocabulary: Vocabulary, shard_triples: int, pair_limit: int, learned_only: bool) -> tuple[DataFrame, Routes, str]:
    """Blocks with what they have to know to send their counts, the routes these take, and the folder for tries."""
    spark = coded.sparkSession
    routes = Routes(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vocabulary.tokens // shard_triples)), pair_limit)
    rows = coded
    if vocabulary.second > pair_limit:
        rows = coded.join(materialise(_hot_pairs(coded, vocabulary, routes, learned_only), "lm-hot"), "block_id", "left")
    folder = new_path(spark, "lm-shards")
    make_dir(spark, folder)
    return rows, routes, folder


# --- scoring --------------------------------------------------------------------------------------------------------------


def _score_message(routes: Routes, docs: int):
    def question(row: dict) -> Iterator[tuple[int, bytes]]:
        c = Coded(row["payload"], docs)
        c.triples()
        routes.with_homes(c)
        for shard, at in routes.cut(c):
            yield shard, _message(c, at, [])

    return question


def _answer(table: pa.Table) -> pa.Table:
    """Codes for each block's message to a shard: of its pairs, and of its triples."""
    path = table["path"][0].as_py()
    trie = Trie(_map(path)) if path is not None else None
    blobs, asked, held = [], [], 0

    def flush() -> None:
        x, y, n, z = (np.concatenate([a[i] for a in asked]).astype(np.uint64) for i in range(4))
        # a pair that many blocks ask for is looked up once
        if len(x) and max(int(x.max()), int(y.max())) < 2**32:
            pairs, of = np.unique((x << np.uint64(32)) | y, return_inverse=True)
            x, y = pairs >> np.uint64(32), pairs & np.uint64(2**32 - 1)
        else:
            of = np.arange(len(x))
        codes = trie.look_up(x, y, np.repeat(of, n.astype(np.int64)), z) if trie else [np.full(k, NONE) for k in (len(x), len(z))]
        codes = codes[0][of], codes[1]
        pairs, triples = np.cumsum([len(a[0]) for a in asked])[:-1], np.cumsum([len(a[3]) for a in asked])[:-1]
        for own in zip(np.split(codes[0], pairs), np.split(codes[1], triples)):
            blobs.append(join_blobs([planes(v) for v in own]))

    for blob in table["blob"]:
        asked.append([unplanes(p) for p in split_blobs(blob.as_py())])
        held += len(asked[-1][3])
        if held >= _LOOKED_UP:
            flush()
            asked, held = [], 0
    if asked:
        flush()
    return pa.table({"bucket": table["bucket"], "block_id": table["block_id"], "blob": pa.array(blobs, pa.binary())})


def _scores(row: dict, vocabulary: Vocabulary, routes: Routes) -> pa.RecordBatch:
    c = Coded(row["payload"], vocabulary.docs)
    c.triples()
    routes.with_homes(c)
    share2, share3 = np.zeros(len(c.x)), np.zeros(len(c.z))
    salts = routes.salts(c)
    for (_, at), blob in zip(routes.cut(c), in_order(row["answers"])):
        pair = c.pair_of[at]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        own = pair[first]
        codes2, codes3 = (unplanes(b) for b in split_blobs(blob))
        share3[at] = _VALUES[codes3]
        # a pair that is dealt speaks where its triple with PAD is
        home = np.zeros(len(own), bool)
        home[np.searchsorted(own, pair[c.z[at] == PAD])] = True
        home |= salts[own] == 1
        share2[own[home]] = _VALUES[codes2[home]]
    weight2 = K3 / (share2 * (c.count[c.x] + K2) + K3)
    # where each symbol's pair and triple end on it: the asked triple that begins one or two places before
    s = c.symbols
    of_pair, of_triple = np.full(len(s), -1, np.int64), np.full(len(s), -1, np.int64)
    of_pair[c.asked + 1] = c.pair_of[c.triple]
    of_triple[c.asked + 2] = c.triple
    scored = np.flatnonzero((s != BEGIN) & (s != PAD))
    of_pair, of_triple, before = of_pair[scored], of_triple[scored], s[scored - 1]
    base = vocabulary.base(c.count)  # of each symbol
    p1, log_base = base[s[scored]], np.log10(base)[s[scored]]
    known = c.count[before]
    p2 = np.where(of_pair >= 0, share2[of_pair], 0.0) + K2 / (known + K2) * p1 if len(c.x) else p1
    # the context of a word is the pair that ends before it; the first word has the beginning alone
    context = np.full(len(scored), -1, np.int64)
    context[1:] = of_pair[:-1]
    context[before == BEGIN] = -1
    inner = (of_triple >= 0) & (before != BEGIN)
    p = np.where(inner, share3[of_triple], 0.0) + np.where(context >= 0, weight2[context], 1.0) * p2 if len(c.z) else p2
    logs = np.log10(np.minimum(p, 1.0))
    begin = np.cumsum(c.lengths + 1) - c.lengths - 1
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(c.ids, pa.int64(), mask=c.null),
            "held_out": pa.array(~c.learned, pa.bool_()),
            "n_tokens": pa.array(c.lengths + 1, pa.int64()),
            "n_known": pa.array(np.add.reduceat((c.count[s[scored]] > 0).astype(np.int64), begin), pa.int64()),
            "train_tokens": pa.array(np.full(len(c.ids), vocabulary.tokens), pa.int64()),
            "base_score": pa.array(np.add.reduceat(log_base, begin), pa.float64()),
            "score": pa.array(np.add.reduceat(logs, begin), pa.float64()),
        }
    )


def score(coded: DataFrame, model: Model) -> DataFrame:
    """Rows of SCORES for every text of coded blocks; held_out says that the block was told not to learn from it."""
    sent = coded.mapInArrow(_sender(_score_message(model.routes, model.vocabulary.docs)), ASKED)
    asked = sent.join(model.shards.select(F.col("shard").alias("bucket"), "path"), "bucket", "left")
    return _scored(coded, asked.groupBy("bucket").applyInArrow(_answer, ASKED), model)


def _scored(coded: DataFrame, answered: DataFrame, model: Model) -> DataFrame:
    v, routes = model.vocabulary, model.routes
    slim = Vocabulary(None, v.docs, v.tokens, v.distinct, v.second)
    answers = answered.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _scores(row, slim, routes)

    return coded.join(answers, "block_id", "left").mapInArrow(finish, SCORES)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all rows of docs."""
    blocks = write_blocks(docs, F.lit(True), id_col, text_col)
    vocabulary = learn_words(blocks)
    return learn_ngrams(code(blocks, vocabulary), vocabulary)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCORES of texts that the model need not have seen."""
    return score(code(write_blocks(docs, F.lit(False), id_col, text_col), model.vocabulary), model)


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of SCORES of all rows, by a model of those that the checksum of their id does not hold out."""
    spark = docs.sparkSession
    with recorded() as raw:
        blocks = write_blocks(docs, ~held_out(F.col(id_col)), id_col, text_col, block_bytes)
    with recorded() as worked:
        vocabulary = learn_words(blocks)
        coded = code(blocks, vocabulary)
        drop(spark, raw)
        collect_garbage(spark)
        drop(spark, [path_of(vocabulary.words)] if vocabulary.words.inputFiles() else [])
        model, answers = learn_and_answer(coded, vocabulary, keep=False)
        out = materialise(_scored(coded, answers, model), "lm-scores")
    drop(spark, [p for p in worked if "lm-scores" not in p])
    return out
