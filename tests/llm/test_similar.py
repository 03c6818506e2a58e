"""Alike texts against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import queries, similar
from codelode.llm.words import WORD, WordHashes, mix

W = regex.compile(WORD)


def bag(t):
    return Counter(W.findall((t or "").lower()))


def brute(rows, threshold=0.75):
    bags = [(k, bag(t)) for k, t in rows if k is not None and bag(t)]
    return sorted(
        {(min(a, b), max(a, b)) for i, (a, x) in enumerate(bags) for b, y in bags[:i] if a != b and (x & y).total() >= threshold * (x | y).total()}
    )


def test_whole_table(spark, sf):
    d = pd.read_parquet(f"{sf}/rule_defs.parquet")
    d = d[d.pack.isin(["sql", "sql-preferences"])]
    want = brute(list(zip(d.rule_key, d.message, strict=True)))
    assert want and sorted(tuple(r) for r in queries.p4_found(spark, sf).collect()) == want


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randint(0, 6)):
        i = rng.randrange(max(1, len(w) - 1))
        rng.choice((lambda: len(w) > 1 and w.pop(i), lambda: w.insert(i, "new"), lambda: w.__setitem__(i, "other"), lambda: w.append(w.pop(i))))()
    return " ".join(w)


def test_recall_over_edits_and_moves(spark):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(4000)]
    rows = []
    for g in range(150):
        sentences = [rng.choices(vocabulary, k=20) for _ in range(4)]
        for _ in range(3):
            rng.shuffle(sentences)
            rows.append((len(rows), ". ".join(edited(rng, s) if rng.random() < 0.5 else " ".join(s) for s in sentences)))
    want = brute(rows)
    got = sorted(tuple(r) for r in similar.alike_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect())
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 300


def test_odd_rows(spark):
    same = "one two three four five six seven eight"
    rows = [(i, same) for i in range(30)] + [(30, None), (31, ""), (32, "..."), (33, "ONE two-three four five six seven eight"), (34, "a"), (35, "a"), (36, "a a"), (None, same), (1, same)]
    rows += [(40, "x " * 3000 + "end"), (41, "x " * 2990 + "end")]
    df = spark.createDataFrame([(k, t, "clash", 0) for k, t in rows], "k long, t string, rep string, sketch long")
    assert sorted(tuple(r) for r in similar.alike_pairs(df, "k", "t").collect()) == brute(rows)
    members = {r.k: (r.class_id, r.links) for r in similar.alike_members(df, "k", "t").collect()}
    assert members[5] == (0, 0) and members[33] == (0, 0) and members[34][0] == members[35][0] == 34 and members[40][1] == 1
    assert similar.alike_pairs(df.limit(0), "k", "t").count() == 0


@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcd"), max_size=25))
@settings(max_examples=200, deadline=None)
def test_alignment_is_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similar.aligned(a, b, 50) == table[-1][-1]
    assert similar.aligned(a, b, 2) <= table[-1][-1]


@given(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=60), st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_alike_is_the_definition(a, b):
    x, y = Counter(a), Counter(b)
    assert similar.alike(a, b, 0.75) == ((x & y).total() >= 0.75 * (x | y).total())


def test_profiles_never_reject_alike_texts(spark):
    rng = random.Random(5)
    rows, h = [], WordHashes()
    for _ in range(200):
        base = rng.choices([f"v{i}" for i in range(rng.choice((3, 40, 400)))], k=rng.randint(1, 90))
        other = edited(rng, base).split() or ["z"]
        pa_, pb = ([int(c[0]) for c in similar.profiles(h(t), np.zeros(len(t), int), 1)] for t in (base, other))
        rows.append((*pa_, *pb, similar.alike(base, other, 0.75)))
    df = spark.createDataFrame(rows, "na long, xa long, la long, ha long, nb long, xb long, lb long, hb long, alike boolean")
    kept = df.withColumn("kept", similar._may_be_alike(0.75))
    assert kept.where("alike AND NOT kept").count() == 0 and kept.where("alike").count() > 50


def test_sketches_of_one_text_do_not_depend_on_its_batch():
    h, seeds = WordHashes(), mix(np.arange(1, 9, dtype=np.uint64))
    texts = [[h([f"w{i * j % 17}" for j in range(i + 1)])] for i in range(12)]
    together = similar.sketches(texts, seeds, 4)
    alone = np.concatenate([similar.sketches([t], seeds, 4) for t in texts])
    assert (together == alone).mean() > 0.98


def test_sketches_of_very_long_texts(monkeypatch):
    h, seeds = WordHashes(), mix(np.arange(1, 9, dtype=np.uint64))
    texts = [[h([f"w{i % 301}" for i in range(5000)])], [h(["a", "b", "a"])]]
    whole = similar.sketches(texts, seeds, 4)
    monkeypatch.setattr(similar, "_WIDE", 9000)
    assert np.array_equal(similar.sketches(texts, seeds, 4), whole)


def test_short_texts_are_found_exactly(spark):
    rng = random.Random(8)
    vocabulary = [f"s{i}" for i in range(60)]
    rows = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(1, 22))
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                rng.choice((lambda w=w: len(w) > 1 and w.pop(rng.randrange(len(w))), lambda w=w: w.append(rng.choice(vocabulary)), lambda w=w: rng.shuffle(w)))()
            rows.append((len(rows), " ".join(w)))
    want = {(a, b) for a, b in brute(rows) if min(len(rows[a][1].split()), len(rows[b][1].split())) <= similar.SHORT}
    got = {tuple(r) for r in similar.alike_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert want <= got <= set(brute(rows)) and len(want) > 150


def test_longer_mers_keep_candidates_of_small_edits():
    h, seeds = WordHashes(), mix(np.arange(1, 65, dtype=np.uint64))
    base = [f"m{i}" for i in range(80)]
    edits = [base, base[:40] + ["new"] + base[40:], base[1:], base[40:] + base[:40]]
    one = similar.sketches([[h(t)] for t in edits], seeds, 3, 1)
    three = similar.sketches([[h(t)] for t in edits], seeds, 3, 3)
    shared = lambda s: [(s[0] == x).mean() for x in s[1:]]
    assert min(shared(one)[:2]) > 0.7 and min(shared(three)[:2]) > 0.5
    assert shared(three)[2] < 0.7  # halves that change places break the text order


def test_a_class_of_many_copies_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "_BLOCK", 7)
    rows = [(i, "one and the same text of several words") for i in range(60)]
    got = similar.alike_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()
    assert len(got) == len({tuple(r) for r in got}) == 60 * 59 // 2
