"""Filter audit, language-model scoring and structure repair against plain versions."""

import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import eliasfano, interaction, ngramlm, queries, repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit ---------------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    least = defaultdict(lambda: math.inf)
    for i, t, _ in rows:
        least[t or ""] = min(least[t or ""], math.inf if i is None else i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": (math.inf if i is None else i) > least[t],
        }
        parts[s or ""].append(({f for f in "ABCDE" if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part, docs in parts.items():
        sums = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [d for d in docs if f in d[0] and not d[0] & before]
                kept = sum(not d[0] & (before | {f}) for d in docs)
                redundant = sum(f in d[0] and bool(d[0] & before) for d in docs)
                sums[f] += len(here)
                out[part, "".join(order), step] = [kept, len(here), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(sums[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("part", "mask", "head", "first", "n", "_of", "_print")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    found = interaction.audit(docs, marks).collect()
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found}


def test_audit_of_odd_rows(spark, odd):
    rows = [(i, t, [None, "", "a", "b"][n % 4]) for n, (i, t) in enumerate(odd)]
    rows += [(20, "A # B", "a"), (None, None, None), (None, None, "a"), (20, "A # B", "a"), (20, "other", "b")]
    labels = [(20, 1, None), (20, 0, 1), (7, 1, 1), (None, 1, 1), (8, None, None)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_groups_cut_by_ranges(spark):
    """A third of all rows share one text, another text is repeated under one id and under none."""
    rng = random.Random(5)
    rows = [(i, "same text again" if i % 3 == 0 else f"text {rng.randrange(150)} " * rng.choice([1, 40]), "ab"[i % 2]) for i in range(900)]
    rows += [(77, "one id", "a")] * 120 + [(None, "no id", "b")] * 120 + [(None, "same text again", "a")] * 50
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        masks = interaction.failure_masks(docs).collect()
        assert sum(r["mask"] >> interaction.COPIES & 1 for r in masks) == sum(
            (math.inf if i is None else i) > min(math.inf if j is None else j for j, u, _ in rows if u == t) for i, t, _ in rows
        )
        assert audited(spark, rows, []) == brute_audit(rows, [])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}


# --- Elias-Fano -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 10**12), (5, 5), (1000, 1000), (3000, 20), (1000, 10**6), (20_000, 10**9), (70, 2**40)])
def test_monotone_sequences(n, top):
    rng = np.random.default_rng(n + top)
    for values in (np.sort(rng.integers(0, top, n)), np.sort((rng.random(n) ** 8 * top).astype(np.int64))):
        values = values.astype(np.uint64)
        w = eliasfano.Writer()
        eliasfano.write_monotone(w, "a", values)
        eliasfano.write_packed(w, "b", values[::-1].copy())
        r = eliasfano.Reader(w.to_bytes())
        found, packed = eliasfano.Monotone(r, "a"), eliasfano.Packed(r, "b")
        assert (found[np.arange(n)] == values).all() and (packed[np.arange(n)] == values[::-1]).all()
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 2 * top + 2, 300).astype(np.uint64), np.array([0, 2**63], np.uint64)])
        if n > 1:
            assert all((x == y).all() for x, y in zip(found.pairs(np.arange(n - 1)), (values[:-1], values[1:])))
        place, equal = found.successor(asked)
        want = np.searchsorted(values, asked)
        assert (place == want).all()
        assert (equal == np.array([i < n and values[i] == a for i, a in zip(want.tolist(), asked)], bool)).all()
        if n >= 1000:  # about two bits beyond the logarithm of the mean gap, and the directories
            assert len(r.array("a.high")) * 8 + len(r.array("a.low.packed")) * 8 < n * (2.8 + max(0, math.log2(top / n))) / 8 + 64


def test_tries_hold_what_was_put_in():
    rng = np.random.default_rng(3)
    triples = sorted({tuple(t) for t in rng.integers(0, [9, 40, 2**34], (4000, 3)).tolist()} | {(8, 39, 2**40), (0, 0, 0)})
    pairs = sorted({t[:2] for t in triples})
    place = {p: i for i, p in enumerate(pairs)}
    x, y = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    pair_of, z = np.array([place[t[:2]] for t in triples]), np.array([t[2] for t in triples], np.uint64)
    times = rng.integers(1, 50, len(triples))
    count_xy = np.bincount(pair_of, times).astype(float)
    trie = ngramlm.Trie(ngramlm.build_trie(x, y, pair_of, z, times, count_xy * 3, count_xy))
    ask = triples + [(9, 0, 0), (0, 41, 5), (8, 39, 2**40 + 1)] + [tuple(t) for t in rng.integers(0, [11, 45, 2**34], (500, 3)).tolist()]
    own = sorted({t[:2] for t in ask})
    number = {p: i for i, p in enumerate(own)}
    share2, share3 = trie.look_up(*(np.array([p[i] for p in own], np.uint64) for i in (0, 1)), np.array([number[t[:2]] for t in ask]), np.array([t[2] for t in ask], np.uint64))
    of = dict(zip(triples, times.tolist()))
    for p, s in zip(own, share2.tolist()):
        n = count_xy[place[p]] if p in place else None
        assert s == (int(ngramlm.NONE) if n is None else round(-math.log10(n / (3 * n + ngramlm.K2)) * ngramlm.STEP))
    for t, s in zip(ask, share3.tolist()):
        assert s == (round(-math.log10(of[t] / (count_xy[place[t[:2]]] + ngramlm.K3)) * ngramlm.STEP) if t in of else int(ngramlm.NONE))


# --- scoring --------------------------------------------------------------------------------------------------------------


def brute_scores(rows):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [" b", *WORD.findall((t or "").translate(up)), " e"]) for i, t in rows]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for _, held, w in texts:
        if not held:
            c1.update(w)
            c2.update(zip(w, w[1:]))
            c3.update(zip(w, w[1:], w[2:]))
    docs = c1.pop(" b", 0)
    n, v = sum(c1.values()), len(c1)
    rounded = lambda p: 10 ** (-round(-math.log10(p) * ngramlm.STEP) / ngramlm.STEP) if p else 0.0
    out = []
    for i, held, w in texts:
        base = score = 0.0
        for j in range(1, len(w)):
            p1 = (c1[w[j]] + 0.1) / (n + 0.1 * (v + 1))
            known = docs if j == 1 else c1[w[j - 1]]
            p = rounded(c2[w[j - 1], w[j]] / (known + ngramlm.K2)) + ngramlm.K2 / (known + ngramlm.K2) * p1
            if j > 1:
                context = c2[w[j - 2], w[j - 1]]
                share = rounded(c3[w[j - 2], w[j - 1], w[j]] / (context + ngramlm.K3))
                before = docs if j == 2 else c1[w[j - 2]]
                p = share + ngramlm.K3 / (rounded(context / (before + ngramlm.K2)) * (before + ngramlm.K2) + ngramlm.K3) * p
            base += math.log10(p1)
            score += math.log10(min(p, 1.0))
        out.append((i, held, len(w) - 1, sum(c1[x] > 0 for x in w[1:]), n, base, score))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2], round(r[5], 6), round(r[6], 6))


def assert_scores(found, rows):
    found, want = sorted((tuple(r) for r in found), key=key), sorted(brute_scores(rows), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for f, w in zip(found, want):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_scores_of_odd_rows(spark, make, odd):
    assert_scores(ngramlm.score_held_out(make(odd)).collect(), odd)


def test_scores_with_small_blocks_and_pairs_dealt_over_shards(spark, make, texts, odd):
    rows = texts[:60] + odd
    blocks = ngramlm.write_blocks(make(rows), ~ngramlm.held_out(F.col("doc_id")), block_bytes=5000)
    vocabulary = ngramlm.learn_words(blocks)
    coded = ngramlm.code(blocks, vocabulary)
    model = ngramlm.learn_ngrams(coded, vocabulary, shard_triples=2000, pair_limit=20)
    assert vocabulary.second > 20 and model.shards.count() > 8 and coded.count() > 10
    assert_scores(ngramlm.score(coded, model).collect(), rows)
    again, answers = ngramlm.learn_and_answer(coded, vocabulary, shard_triples=2000, pair_limit=20)
    assert_scores(ngramlm._scored(coded, answers, again).collect(), rows)
    assert {(r["shard"], r["nodes"]) for r in again.shards.collect()} >= {(r["shard"], r["nodes"]) for r in model.shards.filter("nodes > 0").collect()}
    # what is dealt by the third word too lies in several shards
    many = model.shards.agg(F.sum("nodes")).first()[0]
    plain = ngramlm.learn_ngrams(coded, vocabulary, shard_triples=2000).shards.agg(F.sum("nodes")).first()[0]
    assert many > plain


def test_model_scores_texts_it_has_not_seen(spark, make):
    learned = ["the cat sat on the mat .", "the cat ran home .", "a dog sat on the mat ."] * 5
    model = ngramlm.fit(make(list(enumerate(learned))))
    found = {r["doc_id"]: r for r in ngramlm.score_texts(make([(1, "the cat sat on the mat ."), (2, "mat the on . sat cat the"), (3, None), (4, "zebra THE")]), model).collect()}
    assert found[1]["score"] > found[2]["score"] > found[2]["base_score"] - 5 and found[1]["score"] > found[1]["base_score"]
    assert (found[3]["n_tokens"], found[3]["n_known"]) == (1, 1) and (found[4]["n_tokens"], found[4]["n_known"]) == (3, 2)


def test_scores_without_training_texts_and_of_nothing(spark, make):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, "some words") for i in held]
    found = ngramlm.score_held_out(make(rows)).collect()
    assert {(r["held_out"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found} == {(True, 0, 0, 0.0, 0.0)}
    assert ngramlm.score_held_out(make([])).collect() == []


def test_held_out_texts_are_likelier_than_by_the_base(spark, sf):
    rows = [r for r in queries.op12_lm_scoring(spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# --- structure repair -----------------------------------------------------------------------------------------------------

PATTERN = re.compile(r"(s?(ua)+)?")


def brute_repair(turns):
    """turns: (role, text, fault). The least (cost, audit), by a search over edits, and the repaired lines."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(turns) and PATTERN.fullmatch(roles):
            return cost, audit, "\n".join(lines)
        at = (i, roles[:1], roles[-1:], len(roles) % 2)
        if at in done:
            continue
        done.add(at)

        def go(more, letter, step, role=None, line=None):
            new = roles if role is None else roles + role[:1]
            if role is None or (role[:1] and re.fullmatch(r"s|s?(ua)*u?", new)):
                heapq.heappush(heap, (cost + more, audit + letter, i + step, new, lines if role is None else (*lines, line)))

        for role in ("user", "assistant"):
            go(3, "I", 0, role, f"{role}:")
        if i < len(turns):
            role, text, fault = turns[i]
            go(4, "D", 1)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                go(more, "K", 1, role, f"{role}:{text}")
                for new in ("user", "assistant"):
                    go(3 + more, "R", 1, new, f"{new}:{text}")


def brute_conversation(rows):
    """rows: (turn, role, text) of one conversation as they are."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns, counts = set(), [], Counter()
    for _, role, text in rows:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        turns.append((role, text, fault))
    whole = [t for t, _, _ in rows if t is not None]
    gaps = max(whole) - min(whole) + 1 - len(set(whole)) if whole else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, *brute_repair(turns))


def test_repair_against_a_search(spark):
    rng = random.Random(11)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", " ", "u", "s"], ["Yes.", "No!", "cut", "", " \n", "Yes.", "two\nlines?", "x. \t", "é。", "a:b."]
    rows = []
    for conv in range(250):
        for turn in range(rng.randrange(0, 8)):
            rows.append((conv, rng.choice([turn, turn, turn * 2, None, 3]), rng.choice(roles), rng.choice(texts), True))
    rows += [(1000, 4, "user", "gone", False), (None, 0, "user", "Hi.", True), (None, 5, "assistant", "Ho.", True)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, live boolean").withColumns({c: F.lit("clash") for c in ("fault", "initial", "cost", "turns", "n")})
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df.select("conv_id", "turn", "role", "text", "live")).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text, live in rows:
        by_conv[conv] += [(turn, role, text)] if live else []
    assert found.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        assert found[conv] == brute_conversation(own), own


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += []
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_damage_and_repair_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice(["A.", "B?", None, "long " * 4000 + "end.", "c"])) for conv in range(40) for turn in range(rng.randrange(1, 6))]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (5, None, "user", "Hi."), (6, 0, "user", "x."), (6, 0, "user", "x.")]
    rows += [(-9, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("live", "_copy", "fault")})
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damaged(df)).collect()}
    want = damage(rows)
    assert found.keys() == want.keys()
    for conv, own in want.items():
        assert found[conv] == brute_conversation(own), conv
    assert repair.repair(repair.damaged(df.limit(0))).collect() == []


def test_repair_shuffles_a_row_once(spark, sf):
    plan = repair.repair(repair.damaged(queries.table(spark, sf, "conversations")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "InArrow" not in plan
