"""Operators against brute force, on the smallest tables and on rows that are hard to bear."""

import hashlib
import json
import pickle
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidwork.llm import blocks, bpecodec, chat, decontaminate, exactdedup, jaccard, substring, tokencount, toxicity, urlfilter, vocabulary, warc
from braidwork.llm.blocks import Plan
from braidwork.llm.components import components
from braidwork.llm import words as words_
from braidwork.llm.vocabulary import Vocabulary

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(params=["tables", "odd", "empty"])
def case(request, texts, odd):
    return {"tables": texts, "odd": odd, "empty": []}[request.param]


# ---- 1 and 5

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_token_counts(case, make, library):
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in case)
    assert rows(tokencount.count_tokens(make(case), VOCABULARY)) == want


def test_codec(case, make, library):
    want = Counter()
    for i, t in case:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert rows(bpecodec.encode_digests(make(case), VOCABULARY)) == want


def test_codec_returns_ids(make, library):
    got = bpecodec.encode(make([(1, "Hello there"), (2, None)]), VOCABULARY).orderBy("doc_id").collect()
    assert got[0]["ids"] == library.encode("Hello there", add_special_tokens=False).ids and got[1]["ids"] == [] and got[1]["decoded"] == ""


def test_tokenizing_random_texts(library):
    rng = random.Random(5)
    alphabet = "aaabcdeéßñΣσİ'stdon’ \n\t\x0b\x1c\x85  1234½²٣你🙂ﬁÅ!?.,-_[]{}"
    tricky = ["<|endoftext|>", "a<|startoftext|>b", "aaaaaaaaaaa", "ΑΣ ΟΔΟΣ", "x\x1dy", "’s'S", "\u0345", "e\u0301\u0323"]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    cases += [" ".join(rng.choice(tricky) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    want = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    content = open(VOCABULARY).read()
    codec, counter = bpecodec.Codec(Vocabulary(content)), tokencount.Counter(Vocabulary(content))
    assert [list(map(int, e[0].split())) for e in codec.encode(cases)] == want
    assert counter.count(cases) == [len(w) for w in want]
    assert 0 < codec.failures < codec.words


def test_tokenizing_every_code_point(library):
    content = open(VOCABULARY).read()
    codec, counter = bpecodec.Codec(Vocabulary(content)), tokencount.Counter(Vocabulary(content))
    points = [c for c in [*range(0x20000), *range(0x20000, 0x110000, 97), *range(0x2B700, 0x2CF00), *range(0x32300, 0x33500)] if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 20_000):
        cases = [f"a{chr(c)}b {chr(c)}1{chr(c)} e{chr(c)}\u0301" for c in points[begin : begin + 20_000]]
        want = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
        assert [list(map(int, e[0].split())) for e in codec.encode(cases)] == want
        assert counter.count(cases) == [len(w) for w in want]


def test_tokenizing_mixes_of_odd_characters(library):
    rng = random.Random(7)
    tables = (vocabulary.LETTERS, vocabulary.NUMBERS, vocabulary.UNORDERED, " ".join(r for r, _ in vocabulary.LOWERED))
    odd = [chr(c) for t in tables for a, b in vocabulary._ranges(t) for c in range(a, min(b, a + 40) + 1)]
    plain = list("abcé1 '\n.ẹΣİ각\U00011935\U00011930") + [chr(c) for c in range(0x300, 0x345)]
    cases = ["".join(rng.choice(odd if rng.random() < 0.3 else plain) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    want = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    assert [list(map(int, e[0].split())) for e in bpecodec.Codec(Vocabulary(open(VOCABULARY).read())).encode(cases)] == want


def test_tokenizing_long_words(library):
    rng = random.Random(9)
    cases = ["".join(rng.choice("abcdeéß中🙂\u0558") for _ in range(n)) for n in (255, 256, 257, 300, 5000, 1)] + ["", "the cat sat", "<|endoftext|>" + "x" * 600]
    want = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    codec = bpecodec.Codec(Vocabulary(open(VOCABULARY).read()))
    assert [list(map(int, e[0].split())) for e in codec.encode(cases)] == want and [e[2] for e in codec.encode(cases)] == list(map(len, want))
    for word in (b"hello", "naïve中".encode(), b"aaaaaaaaaaaa", b"1", b"'s"):
        tokens, owner = codec.trie.greedy(np.frombuffer(word, np.uint8), np.array([len(word)]))
        assert tokens.tolist() == codec.guess(word) and not owner.any()


def test_many_long_words_are_encoded_in_time_of_their_length():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(300)) for _ in range(1700))
    v = Vocabulary(open(VOCABULARY).read())
    began = time.perf_counter()
    count = tokencount.Counter(v).count([text])
    counting, began = time.perf_counter() - began, time.perf_counter()
    (got,) = bpecodec.Codec(v).encode([text])
    assert got[2] == count[0] and time.perf_counter() - began < 2 * counting + 2


@pytest.mark.parametrize("change", [{"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"model": {"type": "Unigram"}}])
def test_vocabularies_of_another_kind_are_refused(change):
    spec = json.loads(open(VOCABULARY).read())
    spec |= {k: spec[k] | v if k == "model" else v for k, v in change.items()}
    with pytest.raises(ValueError, match="another kind"):
        Vocabulary(json.dumps(spec))


# ---- 2

def test_toxicity(spark, make):
    rng = random.Random(1)
    plain, bad = [f"v{i}" for i in range(300)], ["vile", "rotten"]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(1, 60))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad) + rng.choice(["", "ly", "ness"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "vile")]
    labels += [(1, 1, None), (None, 0, 1), (2, 0, 7)]
    model = toxicity.fit(make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(make(docs), model).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    empty = {r["doc_id"]: r["score"] for r in got if r["doc_id"] in (1000, 1001)}
    assert empty[1000] == empty[1001] < 0.5
    kept = toxicity.clean(make(docs), model)
    assert kept.columns == make([]).columns and kept.count() < len(docs)


def test_toxicity_pooling_agrees_in_batches():
    rng = np.random.default_rng(3)
    n = toxicity.WORD_BUCKETS + toxicity.STEM_BUCKETS
    embed = rng.normal(size=(n + 1, toxicity.DIM))
    embed[-1] = 0
    model = toxicity.Model(embed, [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], np.zeros(24), np.ones(24))
    texts = ["a b c d", "", None, "one", "x y", " ".join(f"t{i}" for i in range(500))]
    one = np.stack([model.pool(*toxicity.buckets(t)) for t in texts])
    assert np.allclose(model.pools(texts), one)
    toxicity.CHUNK_WORDS, before = 7, toxicity.CHUNK_WORDS
    try:
        assert np.allclose(model.pools(texts), one)
        assert np.allclose(np.stack([model.pool(*toxicity.buckets(t)) for t in texts]), one)
    finally:
        toxicity.CHUNK_WORDS = before


def test_toxicity_learns_from_the_end_of_very_long_texts(spark, make):
    body = " ".join(f"v{i % 300}" for i in range(50_100))
    docs = [(i, body + (" vile" if i % 2 else " mild")) for i in range(50)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(make(docs), labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(make(docs + [(100, "v1 vile"), (101, "v1 mild")]), model).collect()}
    assert got.pop(100) == 1 and got.pop(101) == 0
    assert all(p == i % 2 for i, p in got.items())


def test_toxicity_gathers_no_more_rows_than_the_budget_allows(spark, make, monkeypatch):
    """One labelled id repeated with empty texts is left out, whatever it weighs, and the others are learned from."""
    docs = make([(i, ("vile " if i % 2 else "mild ") * 3) for i in range(60)]).unionByName(spark.range(3000).select(F.lit(500).cast("long").alias("doc_id"), F.lit("").alias("text"), *[F.lit("x").alias(c) for c in ("lang", "source")], F.lit(0).cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in ("uid", "block_id", "digest", "n", "keep_id", "score", "_digest", "comp")]))
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), 500]], "doc_id long, toxic int")
    gathered = []
    monkeypatch.setattr(toxicity, "train", lambda word, stem, y, seed, of=toxicity.train: gathered.append(len(y)) or of(word, stem, y, seed=seed))
    toxicity.fit(docs, labels, max_bytes=1000 * toxicity.LEAST_BYTES)
    assert gathered and gathered[0] <= 60


def test_toxicity_takes_whole_texts_within_the_budget():
    drawn, sizes = [(5, 1), (9, 0), (2, 1), (2, 1), (7, 0)], {5: 60, 9: 50, 2: 20}
    assert toxicity._fitting(drawn, sizes, 100) == [(5, 1), (2, 1), (2, 1), (7, 0)]
    assert toxicity._fitting(drawn, sizes, 10) == [(7, 0)]


def test_toxicity_trains_alike_in_parts_of_a_batch(monkeypatch):
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 5000, rng.integers(0, 200)).astype(np.int32) for _ in range(80)]
    stems = [(w % 700 + toxicity.WORD_BUCKETS).astype(np.int32) for w in words]
    y = np.array([float((w < 60).any()) for w in words])
    whole = toxicity.train(words, stems, y)
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 97)
    parts = toxicity.train(words, stems, y)
    assert np.allclose(whole.embed, parts.embed) and np.allclose(whole.out, parts.out)


def test_toxicity_held_out_rows_and_brute_force_scores(spark, texts, make, odd):
    """held_out by zlib, and scores of whole texts by a plain loop over words and filters."""
    docs = texts + odd
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(make(docs), labels)
    seen = Counter()
    for r in toxicity.score(make(docs), model).collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        seen[(r["doc_id"], round(r["score"], 4))] += 1

    def brute(text):
        found = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(UP).encode())
        pad = np.zeros(toxicity.DIM)

        def vector(w):
            a, b = np.array([0]), np.array([len(w)])
            word = int(words_.hashes(w, a, b)[0] % np.uint64(toxicity.WORD_BUCKETS))
            stem = int(words_.hashes(w[: toxicity.STEM_BYTES], a, np.minimum(b, toxicity.STEM_BYTES))[0] % np.uint64(toxicity.STEM_BUCKETS))
            return model.embed[word].astype(float) + model.embed[toxicity.WORD_BUCKETS + stem]

        rows_ = [vector(w) for w in found] + [pad] * (max(toxicity.WIDTHS) + 1)
        top = []
        for f in model.filters:
            top += [max(sum(rows_[i + o] @ f[o][:, k] for o in range(len(f))) for i in range(len(found) + 1)) for k in range(toxicity.FILTERS)]
        z = model.scale * (np.maximum(np.array(top) + model.bias, 0) @ model.out + model.shift) + model.moved
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    short = [(i, t) for i, t in docs if len(t or "") < 3000]
    got = defaultdict(list)
    for (i, s), n in seen.items():
        got[i].append(s)
    assert len(short) > 100
    for i, t in short:
        assert any(abs(brute(t) - s) < 2e-3 for s in got[i]), i


def test_toxicity_does_not_depend_on_the_order_of_rows(spark, make):
    docs = [(i % 40, f"v{i} " + ("vile" if i % 2 else "mild")) for i in range(120)]
    labels = [(i, i % 2) for i in range(40)] + [(1, 1), (1, 0)]
    models, scores = [], []
    for seed in (1, 2):
        random.Random(seed).shuffle(docs)
        random.Random(seed).shuffle(labels)
        model = toxicity.fit(make(docs).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
        models.append(model)
        scores.append(sorted((r["doc_id"], round(r["score"], 5)) for r in toxicity.score(make(docs), model).collect()))
    one, two = models
    assert (one.embed == two.embed).all() and all((a == b).all() for a, b in zip(one.filters, two.filters)) and (one.out == two.out).all()
    assert (one.scale, one.shift, one.thresholds) == (two.scale, two.shift, two.thresholds)
    # products of a batch round by where a row stands in it, on some machines
    assert [i for i, _ in scores[0]] == [i for i, _ in scores[1]] and all(abs(a - b) < 3e-5 for (_, a), (_, b) in zip(*scores))


def test_toxicity_of_empty_tables(spark, make):
    model = toxicity.fit(make([]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert toxicity.score(make([]), model).count() == 0 and toxicity.clean(make([]), model).columns == make([]).columns
    assert [r["score"] for r in toxicity.score(make([(1, "a")]), model).collect()] == [0.0]


def test_toxicity_without_both_kinds(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(make([(1, "a")]), toxicity.fit(make([(1, "a")]), labels)).collect()] == [0.0]


# ---- 3

def brute_substrings(docs, k):
    last = 2**63
    low = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            low[key] = min(low.get(key, last), last - 1 if d is None else d)
    out = Counter()
    for d, t in docs:
        w, me = words(t), last - 1 if d is None else d
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if low[tuple(w[i : i + k])] < me:
                gone[i : i + k] = [True] * k
        out[(d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))] += 1
    return out


def test_substrings(case, make):
    assert rows(substring.dedup_substrings(make(case), digest=True)) == brute_substrings(case, 13)


@pytest.mark.parametrize("bits", [8, 14, 64])
def test_substrings_whatever_the_hashes(texts, make, bits):
    plan = Plan(0, 1)
    plan.bits, plan.buckets = bits, 8
    assert rows(substring.dedup_substrings(make(texts), digest=True, plan=plan)) == brute_substrings(texts, 13)


def test_substrings_in_two_hops(texts, make):
    plan = Plan(100_000, 1, 50)
    plan.buckets = 23
    plan.in_two_hops(5, 50, 1000)
    plan.bundles = 3
    assert (plan.coarse, plan.fine) == (5, 5)
    small = texts[:60]
    assert rows(substring.dedup_substrings(make(small).repartition(7), digest=True, plan=plan)) == brute_substrings(small, 13)
    assert rows(jaccard.similarity_components(make(small).repartition(7), plan=plan)) == brute_jaccard(small)


def test_questions_stay_as_full_however_large_the_input():
    """Hashes of a row, on either hop, at sizes from a gigabyte to a hundred terabytes; so rows grow as the input."""
    for size in (10**9, 3 * 10**10, 10**12, 10**13, 10**14):
        words, blocks_ = size // 6, size // blocks.BLOCK_BYTES
        plan = Plan(words, 200, blocks_)
        each = words // blocks_
        if plan.coarse:
            assert each // plan.coarse >= blocks.MIN_KEYS and words // (plan.bundles * plan.buckets) >= blocks.MIN_KEYS
            assert words // (plan.bundles * plan.coarse) < 1 << 24  # hashes of a bundle in a coarse range, which one task merges
        else:
            assert each // plan.buckets >= blocks.MIN_KEYS or plan.buckets <= 800


@pytest.mark.parametrize("bits", [3, 40, 57, 64])
@pytest.mark.parametrize("buckets", [1, 2, 7, 5000, 15_894_572])
def test_keys_are_cut_to_ranges_that_do_not_fall(bits, buckets):
    plan = Plan(0, 1)
    plan.bits, plan.buckets, plan.fine = bits, buckets, 3
    top = 2**bits - 1
    keys = np.unique(np.r_[np.random.default_rng(1).integers(0, top, 3000, np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    for coarse in (False, True):
        cuts = list(plan.cut(keys, coarse))
        assert np.concatenate([keys[c] for _, c in cuts]).tolist() == keys.tolist()
        numbers = [b for b, _ in cuts]
        assert numbers == sorted(set(numbers)) and 0 <= numbers[0] and numbers[-1] <= (buckets - 1) // (3 if coarse else 1)
    exact = [int(k) * buckets >> bits for k in keys]
    assert max(abs(a - b) for a, b in zip(plan.bucket(keys).tolist(), exact)) <= 1


def test_cutting_takes_time_and_memory_of_the_keys_only():
    """At the plan for 100 TB: 16 million buckets, a block of some 700,000 keys."""
    plan = Plan(10**14 // 6, 200, 10**14 // blocks.BLOCK_BYTES)
    assert plan.buckets > 10**7 and plan.coarse > 1000
    keys = np.sort(np.random.default_rng(2).integers(0, 2**plan.bits - 1, 700_000, np.uint64, endpoint=True))
    tracemalloc.start()
    began = time.perf_counter()
    n = sum(1 for _ in plan.cut(keys, True))
    took, memory = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n <= plan.coarse and took < 2 and memory < 40 << 20 and len(pickle.dumps(plan)) < 1000


@pytest.mark.parametrize("n", [1, 2, 3, 70, 1000])
def test_paths_are_compacted_by_joins(spark, n):
    """A chain of n segments, one that is unsettled in the middle of another chain, and one alone."""
    def seg(head, nxt, low, times=2, count=2, a=1, same=True):
        return (head, nxt, 10, low, times, count, a, 1, same)

    chain = [seg(i, i + 1 if i < n - 1 else None, 100 + i if i else 5) for i in range(n)]
    broken = [seg(5000, 5001, 7), seg(5001, 5002, 7, times=1), seg(5002, None, 7), seg(6000, None, 9, times=1), seg(6000, None, 8, times=1), seg(6001, None, 9, times=1), seg(6001, None, 8, times=1, a=2)]
    df = spark.createDataFrame(chain + broken, substring.SEGMENT.replace(": ", " "))
    got = {r["head"]: (r["low"], r["windows"], r["settled"]) for r in substring.compacted(df).collect()}
    assert got[0] == (5, 10 * n, True) and (n == 1 or got[n - 1] == (100 + n - 1, 10, True))
    assert not got[5000][2] and not got[5001][2] and got[5002] == (7, 10, True) and got[6000] == (8, 10, True) and not got[6001][2]


@pytest.mark.parametrize("seed", range(3))
def test_substrings_with_few_words(make, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    assert rows(substring.dedup_substrings(make(docs), k=5, digest=True)) == brute_substrings(docs, 5)


def test_substrings_give_texts(make):
    long = " ".join(f"w{i}" for i in range(20))
    got = {r["doc_id"]: r["kept"] for r in substring.dedup_substrings(make([(1, long), (2, f"a {long}  b")])).collect()}
    assert got == {1: long, 2: "a b"}


# ---- 4

def test_exact_dedup(case, make):
    groups = defaultdict(list)
    for i, t in case:
        groups[(t or "").translate(UP)].append(i)
    want = Counter()
    for i, t in case:
        norm = (t or "").translate(UP)
        ids = groups[norm]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep if len(ids) > 1 else i, len(ids), i == keep or len(ids) == 1, sha(norm))] += 1
    got = exactdedup.dedup(make(case))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and rows(got) == want
    for split in (F.lit(True), F.lit(False)):
        assert rows(exactdedup.dedup(make(case), is_history=split)) == want


def test_perfect_hash():
    rng = np.random.default_rng(1)
    digests = np.unique(rng.integers(0, 256, (5000, 32), dtype=np.uint8), axis=0)
    levels, rest, slot = exactdedup.build(digests)
    assert sorted(slot) == list(range(len(digests)))
    table = digests[np.argsort(slot)]
    assert (exactdedup.look_up(levels, len(rest), table, digests) == slot).all()
    other = rng.integers(0, 256, (2000, 32), dtype=np.uint8)
    assert (exactdedup.look_up(levels, len(rest), table, other) == -1).all()


# ---- 6

def brute_jaccard(docs, n=4, percent=85):
    sets = []
    for _, t in docs:
        w = words((t or "").translate(UP))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in by[x])
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for x in s:
            by[x].append(i)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), 2**63), 2**63 if d is None else d)
    return Counter((d, len(sets[i]), None if low[find(i)] == 2**63 else low[find(i)]) for i, (d, _) in enumerate(docs))


def test_jaccard(case, make):
    assert rows(jaccard.similarity_components(make(case))) == brute_jaccard(case)


@pytest.mark.parametrize(("pairs", "turn"), [(-(10**12), 10**6), (10**12, 10**6), (-(10**12), -55)])
def test_jaccard_of_a_group_of_near_copies(make, pairs, turn):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(120):
        w = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        docs.append((i, " ".join(w)))
    docs += [(500 + i, " ".join(f"z{rng.randrange(400)}" for _ in range(40))) for i in range(40)]
    assert rows(jaccard.similarity_components(make(docs), pairs_per_class=pairs, pairs_per_turn=turn)) == brute_jaccard(docs)


def test_jaccard_of_long_words(make):
    halves = [("a" * 256, "b" * 256), ("c" * 300, "d" * 300), ("x" * 256 + "y" * 255 + "z", "z" + "y" * 255 + "x" * 256)]
    docs = [(2 * i + j, a + b if j else b + a) for i, (a, b) in enumerate(halves) for j in (0, 1)]
    docs += [(100 + i, " ".join([t] + [f"w{j}" for j in range(40)])) for i, t in docs]
    assert rows(jaccard.similarity_components(make(docs))) == brute_jaccard(docs)
    assert rows(substring.dedup_substrings(make(docs), k=3, digest=True)) == brute_substrings(docs, 3)


@pytest.mark.parametrize("percent", [50, 100])
def test_jaccard_of_other_thresholds(make, texts, percent):
    assert rows(jaccard.similarity_components(make(texts[:80]), n=2, percent=percent)) == brute_jaccard(texts[:80], 2, percent)


def test_jaccard_of_documents_that_share_one_line(make):
    """A line of 5 n-grams in 5000 documents whose rest is their own: none is linked, and not all pairs are made."""
    docs = [(i, f"one line that all share here {i} x{i % 7} y{i % 11} z{i}") for i in range(5000)]
    got = jaccard.similarity_components(make(docs), pairs_per_class=-(10**12), pairs_per_turn=200).collect()
    assert len(got) == 5000 and all(r["component_id"] == r["doc_id"] for r in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 5), (200, None), (100, 101)]
    got = {r["v"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}


# ---- 7

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("split", [300, 777, 1 << 20])
def test_warc(spark, split):
    big = "é" * 600
    pages = [(1, "http://a/", big), (2, None, big), (2, "x\r\ny", big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "u", "y" * 1000), (9, "u", "\x1f\x8b\x08WARC/1.1" * 40)]
    rng = random.Random(4)
    pages += [(100 + i, f"http://h/{i}", "".join(chr(rng.randrange(32, 1000)) for _ in range(rng.randrange(3000)))) for i in range(60)]
    manifest = warc.write(spark.createDataFrame(pages, PAGES).withColumn("_key", F.lit(1)).repartition(3))
    got = warc.read(manifest, split_bytes=split)
    top = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        again = len(data) >= 1000 and h in top and top[h] != i
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[h] if again else None)] += 1
    assert rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    kept = {r["page_id"]: r["payload"] for r in got.filter("record_type = 'response'").collect()}
    assert all(bytes(kept[i]).decode() == (h or "") for i, _, h in pages if i in kept and i != 2)


def test_warc_reads_in_many_tasks(spark):
    rng = random.Random(8)
    pages = [(i, "u", "".join(chr(rng.randrange(32, 1000)) for _ in range(2000))) for i in range(300)]
    manifest = warc.write(spark.createDataFrame(pages, PAGES).repartition(2))
    got = warc.read(manifest, split_bytes=64 << 10).withColumn("task", F.spark_partition_id())
    assert got.count() == 300 and got.select("task").distinct().count() > 3


@pytest.mark.parametrize("split", [100, 1000, 1 << 20])
def test_warc_damage_is_raised_or_reported(spark, split, tmp_path):
    records = [warc.gzip_member(warc.encode_record(i, "u", random.Random(i).randbytes(300 + 40 * i), None, False)) for i in range(12)]
    starts = [sum(map(len, records[:i])) for i in range(13)]
    for name, bad, at in [("header", 5, 1), ("start", 0, 0), ("body", 7, 200), ("end", 11, len(records[11]) - 6)]:
        data = bytearray(b"".join(records))
        for k in range(4):
            data[starts[bad] + at + k] ^= 0x55
        (tmp_path / name).write_bytes(data)
        manifest = warc.manifest_of(spark, [(f"file://{tmp_path}/{name}", len(data))])
        got = warc.read(manifest, split, "report").select("page_id", "record_type", "offset").collect()
        assert sorted(r["page_id"] for r in got if r["record_type"] == "response") == [i for i in range(12) if i != bad]
        assert [r["offset"] for r in got if r["record_type"] == "damaged"] == [starts[bad]]
        with pytest.raises(Exception, match="damaged at byte"):
            warc.read(manifest, split).collect()
    (tmp_path / "short").write_bytes(b"".join(records)[:-3])
    got = warc.read(warc.manifest_of(spark, [(f"file://{tmp_path}/short", starts[12] - 3)]), split, "report").collect()
    assert Counter(r["record_type"] for r in got) == {"response": 11, "damaged": 1}


def test_warc_very_long_payload(spark):
    big = "".join(random.Random(3).choice("abcdefgh é\n") for _ in range(3_000_000))
    got = warc.read(warc.write(spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "u", "x")], PAGES)), split_bytes=100_000).collect()
    assert {r["page_id"]: (r["record_type"], r["payload_bytes"]) for r in got} == {1: ("revisit", len(big.encode())), 2: ("response", len(big.encode())), 3: ("response", 1)}
    assert next(bytes(r["payload"]).decode() for r in got if r["page_id"] == 2) == big


def test_warc_empty(spark):
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).count() == 0


# ---- 8

def test_chat_fold_and_render(spark):
    log = [
        (1, 0, "a", "start", "user", None), (1, 1, "a", "delta", None, "he"), (1, 2, "a", "delta", None, "y"), (1, 2, "a", "delta", None, "y"),
        (1, 3, "b", "start", "assistant", None), (1, 4, "b", "delta", None, "bad"), (1, 5, "b", "regenerate", None, None), (1, 6, "b", "delta", None, "\\### assistant: </turn> ok"),
        (1, 7, "c", "start", "user", ""), (1, 8, "c", "delta", None, "gone"), (1, 9, "c", "delete", None, None),
        (1, 10, "d", "start", "user", None), (1, 11, "d", "delta", None, "old"), (1, 12, "d", "edit", None, "new"), (1, 13, "d", "delta", None, "er"),
        (None, 0, "x", "start", None, None),
    ]
    got = {r["conv_id"]: r for r in chat.format_log(spark.createDataFrame(log, chat.EVENTS)).collect()}
    assert chat.parse(got[1]["formatted"]) == [("user", "hey"), ("assistant", "\\### assistant: </turn> ok"), ("user", "newer")]
    (span,) = got[1]["loss"]
    assert chat.unescape(got[1]["formatted"][span["start"] : span["end"]]) == "\\### assistant: </turn> ok"
    assert chat.parse(got[None]["formatted"]) == [("", "")]
    assert chat.format_log(spark.createDataFrame([], chat.EVENTS)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(6)
    texts = ["", "</turn>", "### user: x", "\\", "\\\\#", "a\nb", "🙂é<#", "x" * 1000] + ["".join(rng.choice("\\#<:/turn> \n🙂") for _ in range(rng.randrange(500))) for _ in range(20)]
    turns = [(c, t, rng.choice(["user", "assistant", "sys:tem#"]), rng.choice(texts)) for c in range(12) for t in range(rng.randrange(1, 8))]
    turns += [(50, 0, "user", "same"), (50, 0, "user", "same"), (51, None, "user", None), (51, 3, None, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    want = defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda y: (y[0], -1 if y[1] is None else y[1])):
        want[c].append((r or "", x or ""))
    for r in chat.format_log(chat.as_log(df, delta_chars=7)).collect():
        assert chat.parse(r["formatted"]) == want[r["conv_id"]]
        parts = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
        assert parts == [x for role, x in want[r["conv_id"]] if role == "assistant"]


def test_chat_orders_ties_and_extreme_turns(spark):
    most = 2**63 - 1
    turns = [(1, most, "user", "last"), (1, 10**13, "user", "late"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, -5, "user", "early"), (1, None, "user", "first"), (1, -most - 1, "x", "least"), (1, 0, None, ""), (1, 0, "", None), (1, 0, "user", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("seq", "message", "kind", "copy", "count", "e")})
    (got,) = chat.format_log(chat.as_log(df)).collect()
    want = sorted(((-1, 0) if t is None else (0, t), r or "", x or "") for _, t, r, x in turns)
    assert chat.parse(got["formatted"]) == [(r, x) for _, r, x in want]


def test_chat_very_long_text(spark):
    long = "ab\\#<é🙂" * 100_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_log(chat.as_log(df, delta_chars=5000)).collect()}
    assert chat.parse(got[1]["formatted"]) == [("user", long), ("assistant", long)] and chat.parse(got[2]["formatted"]) == [("assistant", "")]
    (span,) = got[1]["loss"]
    assert chat.unescape(got[1]["formatted"][span["start"] : span["end"]]) == long


# ---- 9

def brute_contamination(docs, items, n=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate(UP))
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[a : a + n])].add(str(i))
    sizes = {len(x) for x in wins}
    out = Counter()
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if (key := tuple(w[a : a + m])) in wins:
                    hit.update(range(a, a + m))
                    ids |= wins[key]
        out[(d, len(w), len(hit), ",".join(sorted(ids)))] += 1
    return out


@pytest.mark.parametrize("most", [1 << 23, 12_000])
def test_decontamination(spark, case, make, most):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, "W1 w2"), (901, None), (902, "..."), (903, "One"), (904, " ".join(f"w{i}" for i in range(5, 40))), (905, "日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(make(case), bench, max_item_bytes=most)
    assert rows(got.select("doc_id", "n_words", "n_hit", F.array_join("item_ids", ","))) == brute_contamination(case, items)


def test_decontamination_spans_and_empty_benchmark(spark, make):
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    (r,) = decontaminate.scan(make([(1, "É one -- TWO,\nthree! four")]), bench).collect()
    assert [("É one -- TWO,\nthree! four")[s["start"] : s["end"]] for s in r["spans"]] == ["TWO,\nthree"]
    assert [x["n_hit"] for x in decontaminate.scan(make([(1, "two three")]), bench.limit(0)).collect()] == [0]
    assert [x["doc_id"] for x in decontaminate.clean(make([(1, "two three"), (2, "x")]), bench).collect()] == [2]


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_decontamination_by_items_without_an_id(spark, make, most):
    bench = spark.createDataFrame([(None, "two three"), (None, "five six"), (7, "Two three"), (8, "nine")], "item_id long, text string")
    docs = make([(1, "one two three four"), (2, "x five six y"), (3, "nine z"), (4, "three two")])
    got = decontaminate.scan(docs, bench, max_item_bytes=most)
    assert rows(got.select("doc_id", "n_hit", F.array_join("item_ids", ","))) == Counter([(1, 2, "7"), (2, 2, ""), (3, 1, "8"), (4, 0, "")])
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench, max_item_bytes=most).collect()] == [4]


def test_decontamination_by_items_larger_than_a_pass(make):
    text = " ".join(f"w{i}" for i in range(400))
    for most in (200, 1000, 10_000):
        pieces = [p for b in decontaminate.batches_of([(["a"], text), (["b"], "x y")], 13, most) for p in b]
        windows = lambda t: [tuple(t.split()[i : i + 13]) for i in range(len(t.split()) - 12)]
        assert [w for i, p in pieces if i == ["a"] for w in windows(p)] == windows(text)
    bench = make([]).sparkSession.createDataFrame([("a", text), ("b", "x y")], "item_id string, text string")
    docs = [(1, text[300:600]), (2, "x y z"), (3, "w1 w2"), (4, None), (None, text), (5, "q " * 50_000 + text)]
    got = decontaminate.scan(make(docs), bench, max_item_bytes=300)
    assert rows(got.select("doc_id", "n_words", "n_hit", F.array_join("item_ids", ","))) == brute_contamination(docs, [("a", text), ("b", "x y")])
    assert got.columns == decontaminate.scan(make(docs), bench).columns


def test_decontamination_by_items_that_begin_alike(spark, make):
    """More items than a pattern may have places share four words, a block, or whole windows; blocks, windows and short items overlap."""
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "c", "dd", "é"])
    items = [(i, "which of the following " + " ".join(word() for _ in range(rng.randrange(0, 20)))) for i in range(150)]
    items += [(200 + i, "s t u which of the following is true about x " + " ".join(word() for _ in range(rng.randrange(2, 12)))) for i in range(150)]
    items += [(400 + i, " ".join(f"p{j}" for j in range(13)) + f" q{i % 5}") for i in range(80)] + [(500, "which of the following"), (501, "following is true")]
    docs = [(i, "intro " + t + " " + u) for i, ((_, t), (_, u)) in enumerate(zip(items[::3], items[1::3]))] + [(900, "which of the following"), (901, "p0 p1 p2"), (902, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.MAX_ITEM_BYTES, 3000):
        got = decontaminate.scan(make(docs), bench, max_item_bytes=most)
        assert rows(got.select("doc_id", "n_words", "n_hit", F.array_join("item_ids", ","))) == brute_contamination(docs, items)


def test_decontamination_collects_items_once_and_none_without_words(spark):
    bench = spark.range(100_000).select((F.col("id") % 10).alias("item_id"), F.when(F.col("id") < 50_000, "").when(F.col("id") < 60_000, " .,- ").otherwise("Same words, again").alias("text"))
    found = decontaminate.distinct_items(bench, "item_id", "text").collect()
    assert [(r["ids"], r["text"]) for r in found] == [([str(i) for i in range(10)], "same words again")]


def test_decontamination_of_a_large_benchmark_is_one_pass_in_bounded_memory():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(50_000)]
    items = [([str(i)], " ".join(rng.choices(words, k=100))) for i in range(6000)]  # a quarter of MAX_ITEM_BYTES
    tracemalloc.start()
    matcher = decontaminate.Matcher(items)
    python_bytes = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    nodes = matcher.automaton.get_stats()
    size = sum(len(t) for _, t in items)
    assert size > decontaminate.MAX_ITEM_BYTES // 4 - (1 << 18) and python_bytes + nodes["total_size"] < 40 * size
    assert nodes["nodes_count"] < 1.3 * sum(len(t.split()) for _, t in items)
    text = "x " * 50 + items[77][1] + " y"
    assert matcher.scan(text)[1:] == ([(50, 150)], {"77"}) and not matcher.scan(" ".join(rng.choices(words, k=2000)))[1]


# ---- 10

def brute_url(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        rest = re.split(r"[?#]", rest)[0]
        host, slash, tail = rest.partition("/")
        host, path = host.translate(UP), slash + tail
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best[3] if best else None, best[4] if best else default


def test_urls_that_are_very_long(spark):
    rules = [("block", "a.org", "/x/"), ("allow", "a.org", "/x/" + "y" * 5000)]
    long = "y" * 200_000
    urls = [f"http://{'s.' * 3000}a.org/x/{long}", f"http://a.org/x/z{long}", "http://" + long, f"http://a.org/{long}?{long}#{long}", "http://" + "é." * 100 + "a.org/x/1"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), urlfilter.rules_table(spark, rules))
    assert rows(got) == Counter((i, *brute_url(u, rules)) for i, u in enumerate(urls))


@pytest.mark.parametrize("cap", [8 << 20, 0])
@pytest.mark.parametrize("shapes", [4096, 1])
def test_urls(spark, monkeypatch, cap, shapes):
    monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", cap)
    monkeypatch.setattr(urlfilter, "MAX_SHAPES", shapes)
    rules = urlfilter.CONTRACT_RULES + [("block", "a.b.org", "/"), ("allow", "co.uk", "/x?"), ("block", "", "/never"), ("block", "dup.net", "/"), ("allow", "dup.net", "/")]
    urls = [None, "", "nothing", "http://", "http://example.org", "http://EXAMPLE.org/es/x", "https://sub.example.org/en/123?q#f", "x://y://example.org/en/1", "http://notexample.org/es/", "http://a.b.org/", "http://x.a.b.org/p/", "http://user@example.org:80/es/", "http://example.org?/es/", "http://example.org#/es/", "http://é.com/fr/ü", "http://m.com/de/1", "http://com/fr/", "http://dup.net/1", "http://.org/", "http://org./"]
    urls += urls[:4]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "rule", "verdict", "digest", "x")})
    got = urlfilter.judge(df, urlfilter.rules_table(spark, rules))
    assert rows(got) == Counter((i, *brute_url(u, rules)) for i, u in enumerate(urls))
    none = urlfilter.judge(df, urlfilter.rules_table(spark, rules).limit(0), default="block")
    assert {r["verdict"] for r in none.collect()} == {"block"} and none.count() == len(urls)
    assert urlfilter.judge(df.limit(0), urlfilter.rules_table(spark, rules)).count() == 0
