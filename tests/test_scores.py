"""Scores of cycles, diamonds and history, and that the registered queries take them in."""

from collections import Counter, defaultdict

import __spark_entry__ as e
from codelode.operators import scores
from codelode.plans.bindings import relation


def test_circular_diamond_and_bus_factor(spark):
    edges = spark.createDataFrame([("a/b/r.ts", "a/b/x.ts"), ("a/b/r.ts", "a/b/y.ts"), ("a/b/x.ts", "a/b/l.ts"), ("a/b/y.ts", "a/b/l.ts")], "src string, dst string")
    files = spark.createDataFrame([("a/b/r.ts", 10)], "path string, loc long")
    stats = spark.createDataFrame([("p", 10, 1), ("q", 12, 2), ("r", 30, 2), ("s", 11, 2), ("t", 9, 1)], "path string, change_count long, author_count long")
    got = {r.metric: (r.population, r.hits, r.score) for r in scores.all_scores(edges, files, 2, stats).collect()}
    assert got["circular"] == (3, 2.0, 0.0) and got["diamond"] == (3, 1.0, 98.0) and got["bus_factor"] == (4, 1.0, 75.0) and got["coupling"][2] == 90.0
    assert got["main_sequence"][0] == 0  # the kinds of the files aren't known
    abstract = spark.createDataFrame([("a/b", 0.25)], "module string, a double")
    assert {r.metric: r.score for r in scores.all_scores(edges, files, 0, stats, abstract).collect()}["main_sequence"] == 25.0
    assert {r.metric: r.score for r in scores.all_scores(edges, files, 0, stats).collect()}["circular"] == 100.0


def test_registered_scores_count_the_cycles(spark, sf):
    edges = {(r.src, r.dst) for r in relation(spark, sf, "dep_edges").collect()}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)

    def reached(a):
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    reach = {a: reached(a) for a in list(out)}
    n_cycles = len({min(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]})
    got = {r.metric: r for r in e.queries()["scores"](spark, sf).collect()}
    assert n_cycles > 0 and got["circular"].hits == n_cycles and got["circular"].score == 0
    mean = len(edges) / len(out)
    assert got["coupling"].score == round(max(0.0, 100 - 10 * max(mean - 5, 0) - min(5 * n_cycles, 30)), 1)
    pairs = Counter((a, c) for a in list(out) for b in out[a] - {a} for c in out[b] - {a, b} - out[a])
    diamonds = sum(n >= 2 for n in pairs.values())
    assert (got["diamond"].hits, got["diamond"].score) == (diamonds, max(0.0, 100 - 2.0 * diamonds))
    measured = sum(scores.WEIGHTS[m] for m, r in got.items() if m in scores.WEIGHTS and r.population > 0)
    h = e.queries()["health"](spark, sf).first()
    assert h.measured_weight == round(measured, 1) >= 15.0
    assert h.pain == round(sum(round(scores.WEIGHTS[m] * (100 - r.score) / 10, 2) for m, r in got.items() if m in scores.WEIGHTS and r.population > 0) * 18.6 / measured, 1)
