"""Leak search against brute force."""

import re

import numpy as np
import pandas as pd
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import leakage, queries
from codelode.llm.words import WORD, WordHashes

W = regex.compile(WORD)


def brute(docs, items, window=12):
    def grams(t, n):
        ws = W.findall((t or "").lower())
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()

    sizes = {i: min(window, len(W.findall((t or "").lower()))) for i, t in items}
    own = {i: grams(t, sizes[i]) for i, t in items}
    return sorted((d, i) for d, t in docs for i in own if own[i] & grams(t, sizes[i]))


def run(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, minimum string".replace(", minimum string", ""))
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect())


def test_all_documents(spark, sf):
    d, i = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "eval_items"))
    want = brute(list(zip(d.doc_id, d.text, strict=True)), list(zip(i.item_id, i.text, strict=True)))
    assert want and sorted((r.doc_id, r.item_id) for r in queries.p7_found(spark, sf).collect()) == want


def test_small_and_odd_texts(spark):
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words)
    items = [(1, text), (2, " ".join(words[5:12])), (3, "Only one"), (4, ""), (5, None), (6, "..."), (7, "x"), (8, text), (9, "a a a a a a a a a a a a a")]
    docs = [
        (1, "pre " + "--".join(words[3:15]).upper() + " post"), (2, " ".join(words[3:14])), (3, "not only, one"), (4, None), (5, ""),
        (6, "x"), (7, text * 3), (7, text * 3), (8, "a " * 12), (9, "a " * 11), (10, "ONLY one"),
    ]
    assert run(spark, docs, items) == sorted(set(brute(docs, items)))
    assert run(spark, docs[:0], items) == [] and run(spark, docs, items[:0]) == []


def test_a_crowded_filter_loses_nothing(spark):
    docs, items = [(1, "one two three four five six seven"), (2, "two three")], [(1, "two three"), (2, "nine")]
    assert run(spark, docs, items, bits=6) == run(spark, docs, items) == [(1, 1), (2, 1)]


@given(st.lists(st.integers(0, 6), max_size=40), st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_equal_windows_have_equal_minima(ws, window):
    h = WordHashes()([str(w) for w in ws])
    m = leakage.window_minima(h, window)
    assert len(m) == max(0, len(ws) - window + 1)
    by = {}
    for i, x in enumerate(m):
        assert by.setdefault(tuple(ws[i : i + window]), x) == x
    assert np.array_equal(leakage.window_minima(h[3:], window), m[3:])


def test_words_are_those_of_the_definition(spark):
    rows = spark.createDataFrame([("Ünïcode_x 3²  naïve-9 한국어 it's",)], "t string").selectExpr("t")
    from codelode.llm.words import words

    got = rows.select(words(rows.t).alias("w")).first().w
    assert got == W.findall("Ünïcode_x 3²  naïve-9 한국어 it's".lower()) and re.sub("²", "", "3²") in got
