"""Structural scores of an import graph: population, hits and a value of 0 to 100 per metric.

edges: src, dst (paths); files: path, loc. A module is the first two folders of a path.
An empty population scores 100 with population 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.operators import graph, history


def module_of(path: Column) -> Column:
    return S.folder_of(path, 2)


def _ratio_score(df: DataFrame, metric: str, population: Column, hits: Column) -> DataFrame:
    """100 * (1 - hits / population)."""
    s = df.agg(population.alias("population"), F.coalesce(hits, F.lit(0)).alias("hits"))
    score = F.when(F.col("population") == 0, 100.0).otherwise(F.round(100.0 * (1 - F.col("hits") / F.col("population")), 1))
    return s.select(F.lit(metric).alias("metric"), F.col("population").cast("bigint"), F.col("hits").cast("double"), score.alias("score"))


def _module_degrees(edges: DataFrame) -> DataFrame:
    e = edges.select(module_of(F.col("src")).alias("a"), module_of(F.col("dst")).alias("b"))
    out = e.groupBy(F.col("a").alias("module")).agg(F.count_if(F.col("a") == F.col("b")).alias("internal"), F.count_if(F.col("a") != F.col("b")).alias("out_edges"))
    into = e.where("a <> b").groupBy(F.col("b").alias("module")).agg(F.count("*").alias("in_edges"))
    return out.join(into, "module", "full_outer").fillna(0)


def cohesion(edges: DataFrame, files: DataFrame) -> DataFrame:
    """File-weighted mean of internal / (internal + out); 1 for modules without edges."""
    m = files.groupBy(module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files")).join(_module_degrees(edges), "module", "left").fillna(0)
    own = F.when(F.col("internal") + F.col("out_edges") == 0, 1.0).otherwise(F.col("internal") / (F.col("internal") + F.col("out_edges")))
    s = m.agg(F.count("*").alias("population"), F.sum(own * F.col("files")).alias("w"), F.sum("files").alias("f"))
    return s.select(F.lit("cohesion").alias("metric"), "population", F.round(F.col("w"), 3).alias("hits"), F.round(F.coalesce(100 * F.col("w") / F.col("f"), F.lit(100.0)), 1).alias("score"))


def coupling(edges: DataFrame, n_cycles: int) -> DataFrame:
    """100 - 10 * max(mean fan-out - 5, 0) - min(5 * cycles, 30), over files that import."""
    s = edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n")).agg(F.count("*").alias("population"), F.avg("n").alias("mean"))
    score = F.greatest(F.lit(0.0), 100 - 10 * F.greatest(F.col("mean") - 5, F.lit(0.0)) - min(5 * n_cycles, 30))
    return s.select(F.lit("coupling").alias("metric"), "population", F.round("mean", 3).alias("hits"), F.round(F.coalesce(score, F.lit(100.0)), 1).alias("score"))


def instability(edges: DataFrame) -> DataFrame:
    d = _module_degrees(edges)
    total = F.col("out_edges") + F.col("in_edges")
    return d.select("module", F.when(total == 0, 0.0).otherwise(F.col("out_edges") / total).alias("i"), "internal", "out_edges", "in_edges")


def stable_dependencies(edges: DataFrame) -> DataFrame:
    """Share of edges between modules that go from a stabler module to a less stable one."""
    i = instability(edges).select("module", "i")
    e = edges.select(module_of(F.col("src")).alias("a"), module_of(F.col("dst")).alias("b")).where("a <> b")
    e = e.join(i.select(F.col("module").alias("a"), F.col("i").alias("ia")), "a").join(i.select(F.col("module").alias("b"), F.col("i").alias("ib")), "b")
    return _ratio_score(e, "sdp", F.count("*"), F.count_if(F.col("ia") < F.col("ib")))


def modularity(edges: DataFrame) -> DataFrame:
    """Newman's Q over modules, scored against 0.3."""
    d = _module_degrees(edges)
    m = d.agg((F.sum("internal") + F.sum("out_edges")).alias("m"))
    share = F.col("internal") / F.col("m") - F.pow((2 * F.col("internal") + F.col("out_edges") + F.col("in_edges")) / (2 * F.col("m")), F.lit(2.0))
    s = d.join(F.broadcast(m), how="left").agg(F.count("*").alias("population"), F.sum(share).alias("q"))  # one row
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("q") / 0.3 * 100))
    return s.select(F.lit("modularity").alias("metric"), "population", F.round("q", 4).alias("hits"), F.round(F.coalesce(score, F.lit(100.0)), 1).alias("score"))


def hierarchy(edges: DataFrame) -> DataFrame:
    """Share of imports within a module that go upwards, to a file in a folder above the importer's."""
    up = F.regexp_replace("src", "/[^/]*$", "").startswith(F.concat(F.regexp_replace("dst", "/[^/]*$", ""), F.lit("/")))
    inner = edges.where(module_of(F.col("src")) == module_of(F.col("dst")))
    return _ratio_score(inner, "hierarchy", F.count("*"), F.count_if(up))


def sibling_cross(edges: DataFrame, shared: tuple[str, ...] = ("shared", "common", "utils")) -> DataFrame:
    """Share of imports within a module that cross its first-level folders."""
    sub = lambda c: F.when(F.size(F.split(c, "/")) > 3, F.get(F.split(c, "/"), F.lit(2)))
    inner = edges.where(module_of(F.col("src")) == module_of(F.col("dst"))).select(sub("src").alias("a"), sub("dst").alias("b"))
    cross = F.coalesce((F.col("a") != F.col("b")) & ~F.col("b").isin(*shared), F.lit(False))
    return _ratio_score(inner, "sibling_cross", F.count("*"), F.count_if(cross))


def public_api(edges: DataFrame) -> DataFrame:
    """Share of imports between modules that reach deeper than the module's root or its src folder."""
    deep = ~(F.size(F.split("dst", "/")).isin(3) | F.regexp_like(F.col("dst"), F.lit(r"^[^/]+/[^/]+/src/[^/]+$")))
    return _ratio_score(edges.where(module_of(F.col("src")) != module_of(F.col("dst"))), "public_api", F.count("*"), F.count_if(deep))


def file_size(files: DataFrame, limit: int = 200) -> DataFrame:
    return _ratio_score(files, "file_size", F.count("*"), F.count_if(F.col("loc") > limit))


def god_file(files: DataFrame, limit: int = 150) -> DataFrame:
    """Files of more than twice the limit cost twice their share."""
    s = files.agg(F.count("*").alias("population"), F.count_if(F.col("loc") > 2 * limit).alias("hits"))
    score = F.when(F.col("population") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.round(100 - 200.0 * F.col("hits") / F.col("population"), 1)))
    return s.select(F.lit("god_file").alias("metric"), "population", F.col("hits").cast("double"), score.alias("score"))


#: weight of each metric in the health index (fixed values)
WEIGHTS = {
    "circular": 3.0,
    "feature_sliced_design": 2.5,
    "public_api": 2.0,
    "hierarchy": 2.0,
    "sdp": 2.0,
    "sibling_cross": 1.5,
    "god_file": 1.5,
    "file_size": 1.0,
    "diamond": 1.0,
    "main_sequence": 0.5,
    "modularity": 0.5,
    "cohesion": 0.5,
    "rename_instability": 0.3,
    "bus_factor": 0.3,
}


def circular(edges: DataFrame, n_cycles: int) -> DataFrame:
    """100 without cycles and 0 with any, over files that import."""
    s = edges.agg(F.count_distinct("src").alias("population"))
    return s.select(F.lit("circular").alias("metric"), "population", F.lit(float(n_cycles)).alias("hits"), F.when((F.col("population") > 0) & F.lit(n_cycles > 0), 0.0).otherwise(100.0).alias("score"))


def diamond(edges: DataFrame) -> DataFrame:
    """100 less 2 for each diamond, over files that import."""
    s = edges.agg(F.count_distinct("src").alias("population")).join(F.broadcast(graph.diamonds(edges).agg(F.count("*").alias("hits"))), how="cross")  # one row
    return s.select(F.lit("diamond").alias("metric"), "population", F.col("hits").cast("double"), F.greatest(F.lit(0.0), 100 - 2.0 * F.col("hits")).alias("score"))


def bus_factor(stats: DataFrame) -> DataFrame:
    """Share of files with one author among those that change often."""
    return _ratio_score(history.bus_factor(stats), "bus_factor", F.coalesce(F.sum("population"), F.lit(0)), F.sum("hits"))


def _unmeasured(files: DataFrame, metric: str) -> DataFrame:
    return _ratio_score(files.limit(0), metric, F.count("*"), F.lit(0))


def all_scores(edges: DataFrame, files: DataFrame, n_cycles: int, stats: DataFrame | None = None, abstract: DataFrame | None = None) -> DataFrame:
    """All metrics; without stats (history per path) or abstract (as main_sequence takes it) theirs have no population."""
    parts = [
        cohesion(edges, files), coupling(edges, n_cycles), stable_dependencies(edges), modularity(edges), hierarchy(edges), sibling_cross(edges), public_api(edges), file_size(files), god_file(files),
        circular(edges, n_cycles), diamond(edges),
        bus_factor(stats) if stats is not None else _unmeasured(files, "bus_factor"),
        main_sequence(edges, files, abstract) if abstract is not None else _unmeasured(files, "main_sequence"),
    ]
    return reduce(DataFrame.unionByName, [p.select("metric", F.col("population").cast("bigint"), F.col("hits").cast("double"), "score") for p in parts])


def health(scores: DataFrame) -> DataFrame:
    """(pain, measured_weight, total_weight): weighted gaps of what was measured, scaled to the whole table; null if nothing was.

    A metric without population leaves the weighting; one without a weight never enters it.
    """
    w = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in WEIGHTS.items()])
    s = scores.where((F.col("population") > 0) & w.isNotNull()).withColumn("w", w)
    points = F.round(F.col("w") * (100 - F.col("score")) / 10, 2)
    total = round(sum(WEIGHTS.values()), 1)
    g = s.agg(F.sum(points).alias("points"), F.sum("w").alias("weight"))
    return g.select(
        F.round(F.col("points") * total / F.col("weight"), 1).alias("pain"), F.round(F.coalesce("weight", F.lit(0.0)), 1).alias("measured_weight"), F.lit(total).alias("total_weight")
    )


def main_sequence(edges: DataFrame, files: DataFrame, abstract: DataFrame) -> DataFrame:
    """File-weighted distance |A + I - 1| of modules. abstract: module, a (share of abstract symbols)."""
    m = files.groupBy(module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files"))
    m = m.join(instability(edges).select("module", "i"), "module", "left").join(abstract, "module", "left").fillna(0)
    s = m.agg(F.count("*").alias("population"), F.sum(F.abs(F.col("a") + F.col("i") - 1) * F.col("files")).alias("d"), F.sum("files").alias("f"))
    return s.select(F.lit("main_sequence").alias("metric"), "population", F.round("d", 3).alias("hits"), F.round(F.coalesce(100 * (1 - F.col("d") / F.col("f")), F.lit(100.0)), 1).alias("score"))
