"""Similarity join of word n-gram sets by vertical partitioning.

The n-grams of all documents have one global order, by document frequency (in powers of two), then hash. Blocks ask buckets of
hashes for the frequencies. A document of n n-grams can only have a partner if one of its first n - ceil(t n) + 1 is shared, and an
n-gram of frequency one is shared by none: most documents end here. Rows of equal sets become one class.

The order is cut into fragments, and each class's set with it. For a pair of classes the overlap is counted in each fragment
separately, by a join on (class, fragment), and summed per pair. Pairs come from shared prefix n-grams, but not all of them:
per round each class is held against the best of the leaders of its n-grams, links join classes into components, and only pairs
across components remain. All of those are counted at the end, so no link between different components is lost and a group of
thousands of near copies does not become all its pairs. Where they are many they are counted in turns, each of a share of the
classes and of no more pairs than a bound, and links found in one turn spare the next ones pairs.

Sets of so few n-grams that one more or less is below the threshold are linked only with equal ones and are told by the bytes of
their words. Larger ones are told by 64-bit hashes, where a wrong link takes a chance meeting between two sets that are one n-gram
below the threshold, and wrong equality as many as the sets have n-grams apart.

Defined results: null, empty and wordless texts have no n-grams and are linked with nothing, not even each other; texts of fewer
words than n are one n-gram; of repeated rows each gets the result of its text; a null doc_id counts as larger than any other
and is given back as null unless a smaller id is reached; very long texts count with all their n-grams; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, Plan, ask_keys, in_order, plan_for, split_blobs, unplanes, write_blocks
from .components import components
from .scratch import drop, finished, materialise, path_of, recorded
from .words import hashes, lower_ascii, mix, spans, windows

N_WORDS = 4
PERCENT = 85
FRAGMENTS = 8
_LAST = 2**63 - 1
#: Pairs across components, for each class, above which another round of leaders comes first, as long as leaders find links for
#: one class in 50; and how many are looked at in one turn after that.
PAIRS_PER_CLASS, PAIRS_PER_TURN = 4, 64
LEADER_ROUNDS = 10

#: Longs of a set's parity bitmap.
MARK_LONGS = 8

SETS = "doc_id long, n long, digest binary, lead int, keys array<long>, level array<byte>, mark array<long>"


def _sets(payload: bytes, n: int) -> tuple[Block, list[np.ndarray]]:
    """The sorted distinct n-gram hashes of each document of a block."""
    block = Block(payload)
    start, end = spans(block.text)
    word = hashes(block.text, start, end)
    first = np.searchsorted(start, np.r_[block.begin, len(block.text)])
    grams = windows(word, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:  # a shorter sequence is marked by its length, as it never equals an n-gram
            out.append(mix(windows(word[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return block, out


def _ask_frequency(plan: Plan, n: int):
    def question(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        _, sets = _sets(row["payload"], n)
        keys, times = np.unique(plan.keys(np.concatenate(sets)), return_counts=True)
        return keys, [times.astype(np.uint32)]

    return question


def _answer_frequency(values: list[np.ndarray]) -> list[np.ndarray]:
    """0 for an n-gram that one document has, else the bit length of its frequency."""
    (total,) = values
    return [np.where(total < 2, 0, np.frexp(total.astype(np.float64))[1]).astype(np.uint8)]


def _mark(keys: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: two sets' bitmaps differ in no more bits than the sets have elements apart."""
    bits = 64 * MARK_LONGS
    odd = np.bincount(((keys >> np.uint64(11)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _digest(keys: np.ndarray, text: bytes, bounds: tuple[int, int], n: int, percent: int) -> bytes:
    """Tells sets apart: by the n-grams themselves where only equal sets are similar, else by their hashes."""
    if (100 - percent) * len(keys) >= 100:
        return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()
    words = text[bounds[0] : bounds[1]].split()
    grams = sorted({b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))})
    return hashlib.blake2b(b"\n".join(grams), digest_size=16, person=b"words").digest()


def _select(plan: Plan, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, sets = _sets(row["payload"], n)
                keys = np.unique(plan.keys(np.concatenate(sets)))
                levels = [unplanes(split_blobs(x)[0]) for x in in_order(row["answers"])]
                levels = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
                size, digest, lead, kept, kept_level, mark = [], [], [], [], [], []
                bounds = list(zip(block.begin.tolist(), block.end.tolist()))
                for d, s in enumerate(sets):
                    level = levels[np.searchsorted(keys, plan.keys(s))]
                    order = np.argsort(level, kind="stable")  # the hashes are sorted already
                    s, level = s[order], level[order]
                    alone = int(np.searchsorted(level, 1))
                    prefix = len(s) - (percent * len(s) + 99) // 100 + 1
                    size.append(len(s))
                    if not len(s) or alone >= prefix:
                        digest.append(None)
                        lead.append(None)
                        kept.append(None)
                        kept_level.append(None)
                        mark.append(None)
                    else:
                        digest.append(_digest(s, block.text, bounds[d], n, percent))
                        lead.append(prefix - alone)
                        kept.append(s[alone:].view(np.int64))
                        kept_level.append(level[alone:].view(np.int8))
                        mark.append(_mark(s[alone:]))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(block.ids, pa.int64(), mask=block.null_id),
                        "n": pa.array(size, pa.int64()),
                        "digest": pa.array(digest, pa.binary()),
                        "lead": pa.array(lead, pa.int32()),
                        "keys": pa.array(kept, pa.list_(pa.int64())),
                        "level": pa.array(kept_level, pa.list_(pa.int8())),
                        "mark": pa.array(mark, pa.list_(pa.int64())),
                    }
                )

    return run


def _level_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = np.bincount(batch.column("level").flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=66)
        yield pa.RecordBatch.from_pydict({"level": pa.array(np.arange(len(seen)), pa.int32()), "n": pa.array(seen, pa.int64())})


def _cut(counts: np.ndarray, fragments: int):
    """Cuts each set to fragments of the global order, each with about as many n-grams."""
    before = np.cumsum(counts) - counts
    total = max(1, int(counts.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, lists = batch.column("uid").to_numpy(), batch.column("keys")
            keys, level = lists.flatten().to_numpy(), batch.column("level").flatten().to_numpy().astype(np.int64)
            share = keys.view(np.uint64) / 2.0**64
            part = np.minimum(((before[level] + share * counts[level]) * fragments / total).astype(np.int64), fragments - 1)
            owner = np.repeat(np.arange(len(uid)), np.diff(lists.offsets.to_numpy()))
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]) if len(keys) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "uid": pa.array(uid[owner[new]], pa.int64()),
                    "part": pa.array(part[new], pa.int32()),
                    "keys": pa.ListArray.from_arrays(pa.array(np.r_[new, len(keys)], pa.int32()), pa.array(keys, pa.int64())),
                }
            )

    return run


def _counted(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds the overlap of one fragment, `shared`, to each pair (a, b, ...) and fragment that both have."""
    a = parts.select(F.col("uid").alias("a"), "part", F.col("keys").alias("keys_a"))
    b = parts.select(F.col("uid").alias("b"), "part", F.col("keys").alias("keys_b"))
    counted = pairs.join(a, "a").join(b, ["b", "part"]).withColumn("shared", F.size(F.array_intersect("keys_a", "keys_b")))
    return counted.drop("keys_a", "keys_b", "part")


def _linked(pairs: DataFrame, parts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b, ...) whose overlap, counted by fragment and summed, is enough.

    The rarest fragment is counted first. With what the sizes of the other segments allow at most it settles most pairs that
    do not belong together; the others are counted in every fragment left.
    """
    need = percent * (F.col("n_a") + F.col("n_b"))
    first = _counted(pairs.select("a", "b"), parts.filter("part = 0")).select("a", "b", F.col("shared").alias("rare"))
    left = pairs.join(first, ["a", "b"], "left").withColumn("rare", F.coalesce("rare", F.lit(0)))
    left = left.join(sizes.select(F.col("uid").alias("a"), F.col("sizes").alias("sizes_a")), "a")
    left = left.join(sizes.select(F.col("uid").alias("b"), F.col("sizes").alias("sizes_b")), "b")
    most = F.col("rare")
    for part in range(1, FRAGMENTS):
        most = most + F.least(*[F.coalesce(F.try_element_at(s, F.lit(part)), F.lit(0)) for s in ("sizes_a", "sizes_b")])
    left = left.filter((100 + percent) * most >= need).drop("sizes_a", "sizes_b")
    left = materialise(left, "jaccard-left")
    rest = _counted(left.select("a", "b"), parts.filter("part > 0")).groupBy("a", "b").agg(F.sum("shared").alias("common"))
    summed = left.join(rest, ["a", "b"], "left")
    return summed.filter((100 + percent) * (F.col("rare") + F.coalesce("common", F.lit(0))) >= need).drop("rare", "common")


def _possible(n_a, at_a, n_b, at_b, percent: int):
    """Whether a pair of unequal sets can be similar whose first common n-gram has these places in the order of their sets."""
    need = percent * (n_a + n_b)
    unequal = (100 - percent) * F.greatest(n_a, n_b) >= 100
    return unequal & ((100 + percent) * (n_a - at_a) >= need) & ((100 + percent) * (n_b - at_b) >= need)


def _near(percent: int):
    """Whether the n-grams that the sets a and b surely don't share are few enough: those of their own and where the bitmaps differ."""
    apart = F.col("alone_a") + F.col("alone_b")
    for i in range(MARK_LONGS):
        apart = apart + F.bit_count(F.col("mark_a")[i].bitwiseXOR(F.col("mark_b")[i]))
    return (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def _relabel(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after links (a, b: old components) were added."""
    merged = components(links).select(F.col("v").alias("comp"), F.col("comp").alias("_to"))
    return comp.join(merged, "comp", "left").select("uid", F.coalesce("_to", "comp").alias("comp"))


def similarity_components(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", pairs_per_class: int = PAIRS_PER_CLASS, pairs_per_turn: int = PAIRS_PER_TURN, plan: Plan | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; linked where intersection / union >= percent / 100."""
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    with recorded() as paths:
        out = _similarity_components(docs, n, percent, id_col, text_col, pairs_per_class, pairs_per_turn, plan)
    return finished(out, "jaccard", paths)


def _similarity_components(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, pairs_per_class: int, pairs_per_turn: int, plan: Plan | None) -> DataFrame:
    spark = docs.sparkSession
    with recorded() as paths:
        blocks = write_blocks(docs, id_col, text_col, lower_ascii)
    if plan is None:
        plan = plan_for(blocks)
        plan.bits = max(40, plan.bits // 2 + 12)  # a hash that meets another by chance only looks shared
    payload = blocks.select("block_id", "payload")
    known = payload.join(ask_keys(payload, plan, _ask_frequency(plan, n), ["sum"], _answer_frequency), "block_id", "left")
    sets = materialise(known.mapInArrow(_select(plan, n, percent), SETS).withColumn("uid", F.monotonically_increasing_id()), "jaccard-sets")
    drop(spark, paths)

    # Rows of equal sets are a class, told by one of its rows.
    id_ = F.coalesce("doc_id", F.lit(_LAST))
    grouped = sets.filter("digest is not null").groupBy("digest").agg(F.min(id_).alias("low"), F.min("uid").alias("uid"), F.count("*").alias("rows"))
    classes = materialise(grouped, "jaccard-classes")
    rows = materialise(sets.select("doc_id", "n", "digest"), "jaccard-rows")
    first = sets.filter("digest is not null").drop("doc_id", "digest").join(classes.select("uid"), "uid", "left_semi")
    first = materialise(first, "jaccard-first")
    drop(spark, [path_of(sets)] if sets.inputFiles() else [])

    counts = np.zeros(66, np.int64)
    for level, number in first.select("level").mapInArrow(_level_counts, "level int, n long").groupBy("level").sum("n").collect():
        counts[level] = number
    parts = materialise(first.select("uid", "keys", "level").mapInArrow(_cut(counts, FRAGMENTS), "uid long, part int, keys array<long>"), "jaccard-parts")
    # Sizes of segments by class, written so that a join with pairs deals both sides anew and splits a leader of many.
    size = F.struct("part", F.size("keys").alias("m"))
    sizes = materialise(parts.groupBy("uid").agg(F.map_from_entries(F.collect_list(size)).alias("sizes")), "jaccard-sizes")
    # `at` is the place of the n-gram in the order of the whole set, whose first are those that no other document has
    postings = first.select("uid", "n", (F.col("n") - F.size("keys")).alias("alone"), F.posexplode(F.slice("keys", F.lit(1), F.col("lead"))).alias("at", "s"))
    postings = materialise(postings.select("s", "uid", "n", "alone", (F.col("alone") + F.col("at")).alias("at")), "jaccard-postings")
    marks = materialise(first.select("uid", "mark"), "jaccard-marks")
    drop(spark, [path_of(first)] if first.inputFiles() else [])
    comp = _components(postings, parts, sizes, marks, classes.count(), percent, pairs_per_class, pairs_per_turn)

    lows = comp.join(classes, "uid").groupBy("comp").agg(F.min("low").alias("component"))
    per_class = comp.join(classes, "uid").join(lows, "comp").select(F.col("digest").alias("_digest"), "component")
    per_class = materialise(per_class, "jaccard-components")
    out = rows.join(per_class, F.col("digest") == F.col("_digest"), "left")
    component = F.coalesce(F.nullif("component", F.lit(_LAST)), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _components(postings: DataFrame, parts: DataFrame, sizes: DataFrame, marks: DataFrame, n_classes: int, percent: int, pairs_per_class: int, pairs_per_turn: int) -> DataFrame:
    """(uid, comp) of every class with a posting."""
    comp = materialise(postings.select("uid", F.col("uid").alias("comp")).distinct(), "jaccard-comp")
    most, at_once, productive = pairs_per_class * n_classes + 10_000, pairs_per_turn * n_classes + 10_000, True
    for turn in range(LEADER_ROUNDS + 1):
        now = postings.join(comp, "uid")
        # A leader has few n-grams of its own: of a group of near copies the one that most are copies of. Later turns try others.
        central = F.col("alone") / F.col("n") + F.lit(0.02 * turn) * F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(1000)) / 1000
        order = F.struct(central.alias("h"), F.col("uid").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("comp").alias("comp_b"))
        # Counted by n-gram and component first, so that a frequent n-gram is aggregated before it is gathered.
        by_comp = now.groupBy("s", "comp").agg(F.count("*").alias("m"), F.min(order).alias("lead"))
        leads = by_comp.groupBy("s").agg(F.min("lead").alias("lead"), F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("k"))
        # at most so many pairs across components: the rows outside an n-gram's largest component, times all its rows
        pairs = ((F.col("m") - F.col("top.m")).cast("double") * F.col("m")).alias("pairs")
        leads = materialise(leads.filter("k > 1").select("s", "lead.*", F.col("top.comp").alias("top"), pairs), "jaccard-leads")
        left = leads.agg(F.sum("pairs")).first()[0]
        if not left:
            return comp
        if left <= most or not productive or turn == LEADER_ROUNDS:
            return _all_pairs(postings, parts, sizes, marks, comp, leads, math.ceil(left / at_once), percent)
        now = now.withColumnsRenamed({"uid": "a", "n": "n_a", "at": "at_a", "alone": "alone_a", "comp": "comp_a"})
        # each class is held against the leader with which it shares most of its prefix
        fits = _possible(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), percent)
        pairs = now.join(leads.drop("pairs", "top"), "s").filter((F.col("comp_a") != F.col("comp_b")) & fits)
        pairs = pairs.groupBy("a", "b", "n_a", "n_b", "comp_a", "comp_b").count()
        best = F.max(F.struct("count", "b", "n_b", "comp_b")).alias("best")
        pairs = pairs.groupBy("a", "n_a", "comp_a").agg(best).select("a", "best.b", "n_a", "best.n_b", "comp_a", "best.comp_b")
        comp, found = _join_linked(comp, pairs, parts, sizes, percent)
        productive = 50 * found >= n_classes
    return comp


def _join_linked(comp: DataFrame, pairs: DataFrame, parts: DataFrame, sizes: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """Components after the similar of the pairs (a, b, n_a, n_b, comp_a, comp_b) were linked, and how many links there were."""
    links = _linked(materialise(pairs, "jaccard-pairs"), parts, sizes, percent)
    links = materialise(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "jaccard-links")
    found = links.count()
    return (materialise(_relabel(comp, links), "jaccard-comp") if found else comp), found


def _all_pairs(postings: DataFrame, parts: DataFrame, sizes: DataFrame, marks: DataFrame, comp: DataFrame, leads: DataFrame, turns: int, percent: int) -> DataFrame:
    """Counts every pair across components that shares an n-gram of both prefixes, in turns over shares of the classes.

    Of such a pair one class at least is open, that is not in the n-gram's largest component as it is now. A turn has the open
    rows of its share of the classes, so every pair has its turn, whichever components have been joined by then. Classes of one
    n-gram meet by length class, as similar sets are about equally large.
    """
    step = 1.000001 * math.log(100 / percent) or 1.0
    length = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    rows = postings.join(leads.select("s", "top"), "s").withColumn("length", length)
    rows = rows.join(comp.select("uid", F.col("comp").alias("at_first")), "uid").join(marks, "uid")
    rows = materialise(rows.withColumn("open", F.col("at_first") != F.col("top")).drop("top", "at_first"), "jaccard-rows-left")
    names = {"uid": "a", "n": "n_a", "at": "at_a", "alone": "alone_a", "mark": "mark_a", "comp": "comp_a", "open": "open_a"}
    for turn in range(turns):
        now = rows.join(comp, "uid").withColumnsRenamed(names)
        own = now.filter("open_a").filter(F.pmod(F.xxhash64("a"), F.lit(turns)) == turn)
        near = F.array(*[F.col("length") + i for i in (-1, 0, 1)])
        own = own.withColumn("length", F.explode(near))
        other = now.withColumnsRenamed({c: c[:-1] + "b" for c in names.values()})
        fits = _possible(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), percent) & _near(percent)
        once = ~F.col("open_b") | (F.col("a") < F.col("b"))
        pairs = own.join(other, ["s", "length"]).filter((F.col("comp_a") != F.col("comp_b")) & once & fits)
        sides = F.array_sort(F.array(*[F.struct(F.col(x).alias("v"), F.col(f"n_{x}").alias("n"), F.col(f"comp_{x}").alias("comp")) for x in "ab"]))
        pairs = pairs.select(sides.alias("p")).distinct()
        pairs = pairs.select(*[F.col("p")[i][f].alias(name) for i, x in enumerate("ab") for f, name in (("v", x), ("n", f"n_{x}"), ("comp", f"comp_{x}"))])
        comp, _ = _join_linked(comp, pairs, parts, sizes, percent)
    return comp
