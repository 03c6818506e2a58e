"""Commit history: per-path statistics, co-change, ownership, risk and lifecycle.

commit_files: sha, ts, author, path, added, deleted, tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import scalars as S

MIN_FILES, MAX_FILES, TOP_PARTNERS, RECENT_DAYS = 2, 25, 10, 30


def path_stats(commit_files: DataFrame, now: Column) -> DataFrame:
    """Changes, churn, last change, authors and the same for the last RECENT_DAYS days, per path."""
    c = commit_files.groupBy("sha", "path").agg(
        F.max("ts").alias("ts"), F.max("author").alias("author"), F.sum(F.col("added") + F.col("deleted")).alias("churn")
    )
    recent = F.col("ts") >= now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS")
    return c.groupBy("path").agg(
        F.count("*").alias("change_count"), F.sum("churn").alias("churn"), F.max("ts").alias("last_modified"), F.count_distinct("author").alias("author_count"),
        F.count_if(recent).alias("recent_change_count"), F.coalesce(F.sum(F.when(recent, F.col("churn"))), F.lit(0)).alias("recent_churn"),
    )


def tag_counts(commit_files: DataFrame) -> DataFrame:
    return commit_files.where(F.col("tag").isNotNull()).select("sha", "path", "tag").distinct().groupBy("path", "tag").agg(F.count("*").alias("n"))


def author_commits(commit_files: DataFrame) -> DataFrame:
    return commit_files.select("sha", "path", "author").distinct().groupBy("path", "author").agg(F.count("*").alias("n"))


def history_window(commit_files: DataFrame) -> DataFrame:
    return commit_files.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("sha").alias("commits"))


def pair_counts(commit_files: DataFrame) -> DataFrame:
    """(a, b, n), both directions. Commits above MAX_FILES are left out, which bounds the pairs of one commit."""
    files = commit_files.select("sha", "path").distinct()
    sets = files.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n").between(MIN_FILES, MAX_FILES)).select("sha")
    files = files.join(sets, "sha")
    listed = files.groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    pairs = listed.select(F.col("paths"), F.posexplode("paths").alias("i", "a")).select("a", F.explode(F.slice("paths", F.col("i") + 2, F.size("paths"))).alias("b"))
    half = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


def coupling(commit_files: DataFrame, top: int = TOP_PARTNERS) -> DataFrame:
    """The `top` partners of each path; ties keep path order."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return pair_counts(commit_files).withColumn("place", place).where(F.col("place") <= top)


def cochange_edges(coupled: DataFrame) -> DataFrame:
    """Undirected edges from the truncated partner lists: the greater of the surviving directions."""
    return coupled.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("n").alias("n")).select(F.col("x").alias("a"), F.col("y").alias("b"), "n")


def layer_cochurn(commit_files: DataFrame, top: int = 20, shown: int = 5, least: int = 2) -> DataFrame:
    """Pairs of top-level folders by how many file pairs of theirs change together `least` times or more."""
    p = pair_counts(commit_files).where((F.col("a") < F.col("b")) & (F.col("n") >= least))
    la, lb = S.folder_of(F.col("a"), 2), S.folder_of(F.col("b"), 2)
    p = p.withColumn("la", la).withColumn("lb", lb).where(F.col("la") != F.col("lb"))
    p = p.withColumn("x", F.least("la", "lb")).withColumn("y", F.greatest("la", "lb"))
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc("n"), "a", "b"))
    g = p.withColumn("place", place).groupBy("x", "y").agg(
        F.sum("n").alias("co_changes"), F.count("*").alias("pairs"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "a", "b")))), lambda s: F.concat(s["a"], F.lit("+"), s["b"])), ",").alias("examples"),
    )
    return g.orderBy(F.desc("co_changes"), "x", "y").limit(top)


def hidden_coupling(edges: DataFrame, deps: DataFrame, least: int = 10) -> DataFrame:
    """Pairs that change together `least` times or more with no import either way. deps: src, dst paths."""
    linked = deps.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return edges.where(F.col("n") >= least).join(linked, ["a", "b"], "left_anti")


def node_metrics(stats: DataFrame, loc: DataFrame, degrees: DataFrame, now: Column) -> DataFrame:
    """Risk, hotspot and lifecycle per path. loc: path, loc; degrees: path, fan_in, fan_out."""
    n = stats.join(loc, "path", "full_outer").join(degrees, "path", "full_outer")
    zero = {c: 0 for c in ("change_count", "churn", "author_count", "recent_change_count", "recent_churn", "loc", "fan_in", "fan_out")}
    n = n.fillna(zero)
    n = n.where((F.col("change_count") + F.col("churn") + F.col("loc") + F.col("fan_in") + F.col("fan_out")) > 0)
    # of a row per distinct churn with its count, read from the history alone: the three-way join is not repeated for it
    counts = stats.where(F.col("churn") > 0).groupBy("churn").agg(F.count("*").alias("n"))
    median = counts.agg(F.percentile("churn", F.lit(0.5), F.col("n")).alias("median_churn"))
    n = n.join(F.broadcast(median), how="left")  # one row
    risk = 0.4 * F.col("change_count") + 0.2 * F.col("churn") + 0.4 * (F.col("fan_in") + F.col("fan_out"))
    hotspot = F.when(F.col("change_count") >= 2, F.col("change_count") * F.col("loc")).otherwise(0)
    busy = F.col("churn") > F.coalesce("median_churn", F.lit(0))
    fresh = F.coalesce(F.col("last_modified") >= now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"), F.lit(False))
    lifecycle = F.when(busy & fresh, "Volatile").when(busy, "Settled").when(fresh, "Fresh").otherwise("Stable")
    return n.select("path", "change_count", "churn", "loc", "fan_in", "fan_out", "author_count", F.round(risk, 4).alias("risk"), hotspot.alias("hotspot"), lifecycle.alias("lifecycle"))


def folder_rollup(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.groupBy(S.folder_of(F.col("path"), depth).alias("folder")).agg(
        F.count("*").alias("files"), F.round(F.sum("risk"), 3).alias("risk_sum"), F.round(F.avg("risk"), 3).alias("risk_avg"), F.max("risk").alias("risk_max"),
        F.sum("change_count").alias("changes"), F.sum("churn").alias("churn"), F.sum("loc").alias("loc"),
    )


def bus_factor(stats: DataFrame, least: int = 10) -> DataFrame:
    """Score and share of single-author files among those with `least` changes or more."""
    s = stats.where(F.col("change_count") >= least).agg(F.count("*").alias("population"), F.count_if(F.col("author_count") == 1).alias("hits"))
    return s.select(F.lit("bus_factor").alias("metric"), "population", "hits")


def fix_ratio(commit_files: DataFrame) -> DataFrame:
    t = tag_counts(commit_files)
    s = t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("population"), F.coalesce(F.sum(F.when(F.col("tag") == "FIX", F.col("n"))), F.lit(0)).alias("hits"))
    return s.select(F.lit("fix_ratio").alias("metric"), "population", "hits")


def knowledge_silo(stats: DataFrame, least: int = 6) -> DataFrame:
    """Paths with `least` authors or more."""
    return stats.where(F.col("author_count") >= least).select("path", "author_count", "change_count")


def alias_merge(stats: DataFrame, aliases: DataFrame) -> DataFrame:
    """Folds the statistics of renamed paths into the path they are now. aliases: old, canonical."""
    s = stats.join(aliases.withColumnRenamed("old", "path"), "path", "left").withColumn("path", F.coalesce("canonical", "path"))
    return s.groupBy("path").agg(F.sum("change_count").alias("change_count"), F.sum("churn").alias("churn"), F.max("last_modified").alias("last_modified"))
