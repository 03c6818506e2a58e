"""Mixing to target shares by hand and against plain sums."""

from collections import defaultdict

import pandas as pd
import pytest

from codelode.llm import mixing, queries

T = "source string, target_share double, max_repeats int"


def test_mix_of_the_documents(spark, sf):
    import base64

    import public_tokenizers
    import tiktoken

    d = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    t = pd.read_parquet(f"{sf}/mix_targets.parquet").set_index("source")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = queries.p8_mix(spark, sf).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    used, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(enc.encode_ordinary(d.text[r.doc_id]))
        assert r.tokens == n and d.source[r.doc_id].strip().lower().replace("_", "-") == r.source and 1 <= r.uses <= t.max_repeats[r.source]
        used[r.source] += n * r.uses
        longest[r.source] = max(longest[r.source], n)
    all_longest = d.assign(s=d.source.str.strip().str.lower().str.replace("_", "-"), n=[len(enc.encode_ordinary(x)) for x in d.text]).groupby("s").n.max()
    total, named = sum(used.values()), t.target_share[list(used)].sum()
    for s in used:
        assert abs(used[s] - total * t.target_share[s] / named) <= all_longest[s] + all_longest.sum() * t.target_share[s]
    shares = {r.source: r for r in queries.p8_shares(spark, sf).collect()}
    assert len(shares) == len(t) and sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    assert all(shares[s].tokens_used == used[s] for s in used) and shares["talk-transcript"].tokens_used == 0


def test_budgets_by_hand(spark):
    counted = spark.createDataFrame([(i, "a", 1) for i in range(6000)] + [(i, "b", 2) for i in range(6000, 6500)] + [(9999, "c", 5)], "k long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("B ", 0.5, 4), ("none", 0.3, 2)], T)
    mixed, shares = mixing.mix(counted, targets)
    by = {r.source: r for r in shares.collect()}
    assert (by["a"].tokens_used, by["b"].tokens_used, by["none"].tokens_used) == (4000, 4000, 0)
    assert by["b"].most_uses == 4 and by["a"].docs_used == 4000 and "c" not in by
    mixed, shares = mixing.mix(counted, targets, total=2000)
    assert sorted(r.tokens_used for r in shares.collect()) == [0, 1000, 1000]
    assert mixing.mix(counted.limit(0), targets)[0].count() == 0 and mixing.mix(counted, targets.limit(0))[0].count() == 0


def test_exponents():
    sizes, repeats = {"a": 100, "b": 10}, {"a": 1, "b": 2}
    assert mixing.tempered(sizes, 1.0) == pytest.approx({"a": 100 / 110, "b": 10 / 110}) and mixing.tempered(sizes, 0.0) == {"a": 0.5, "b": 0.5}
    w, total, exponent = mixing.solve(sizes, repeats, None, total=60)
    assert total == pytest.approx(60) and w["b"] * 60 == pytest.approx(20) and 0 < exponent < 1  # as even as two passes of b allow
    w, total, exponent = mixing.solve(sizes, repeats, {"a": 0.5, "b": 0.5}, total=80)
    assert w["b"] * 80 == pytest.approx(20) and 0 < exponent < 1  # short of the targets, at the limit
    w, _, exponent = mixing.solve(sizes, repeats, None, least_entropy=0.6)
    assert mixing.entropy(w) == pytest.approx(0.6, abs=1e-6) and 0 < exponent < 1
    assert mixing.solve({}, {}) == ({}, 0.0, 0.0)


def test_odd_rows_are_not_counted(spark):
    df = spark.createDataFrame(
        [(1, "Rule_Docs ", "some text", 0), (2, None, "text", 0), (3, "x", None, 0), (4, "x", "", 0), (None, "x", "text", 0), (5, " x", "a" * 100_000, 0)],
        "doc_id long, source string, text string, tokens int",
    )
    got = {r.k: (r.source, r.tokens) for r in mixing.count_tokens(df, "doc_id", "source", "text", mixing.tokenizer_path()).collect()}
    assert set(got) == {1, 5} and got[1] == ("rule-docs", 2) and got[5][0] == "x"


def test_blocks_that_end_at_the_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    for first in (40, 60, 80):
        rows = [(i, "a", 10) for i in range(8)] + [(first + i, "b", 10) for i in range(4)] + [(first + 4 + i, "b", 10) for i in range(4)]
        counted = spark.createDataFrame(rows[:12], "k long, source string, tokens long")
        mixed, shares = mixing.mix(counted, targets)
        assert {r.source: r.tokens_used for r in shares.collect()} == {"a": 40, "b": 40}
        for s, n in (("a", 4), ("b", 4)):
            assert sorted(r.position for r in mixed.where(f"source = '{s}'").collect()) == list(range(n))


def test_many_blocks_keep_one_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    monkeypatch.setattr(mixing, "_MANY", 4)
    counted = spark.createDataFrame([(i, "a", 1 + i % 7) for i in range(300)], "k long, source string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    whole = counted.agg({"tokens": "sum"}).first()[0]
    mixed, _ = mixing.mix(counted, targets, total=whole * 1.5)
    rows = sorted((r.position, r.uses, r.tokens) for r in mixed.collect())
    assert [p for p, _, _ in rows] == list(range(300)) and [u for _, u, _ in rows] == sorted((u for _, u, _ in rows), reverse=True)
    assert whole * 1.5 - 7 < sum(u * t for _, u, t in rows) <= whole * 1.5


def test_tempering_bends_the_targets_to_the_repeats(spark, sf):
    counted = spark.createDataFrame([(i, "a", 10) for i in range(90)] + [(100 + i, "b", 10) for i in range(10)], "k long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], T)
    shares = {r.source: r for r in mixing.mix(counted, targets, of_corpus=1.0)[1].collect()}
    # the targets allow 800 tokens of the 1000; at the size of the corpus b gives all of its four passes at most
    assert 0 < shares["a"].exponent < 1 and shares["b"].tokens_used == 400 and shares["a"].tokens_used == 600
    got = {r.source: r for r in queries.p8_tempered_shares(spark, sf).collect()}
    assert all(0 <= r.exponent <= 1 and r.most_uses <= r.max_repeats for r in got.values())
