"""Recommendations from node metrics: gates per group, capped lists, effort against gain, dead candidates, critical files.

nodes: path, change_count, churn, loc, fan_in, fan_out, author_count, risk, hotspot, lifecycle; fixes: path, n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows per group (fixed values)
MAX_ROWS = {"bug-prone": 20, "circular": 15, "hot-churn": 15, "fat-fanout": 15, "hidden-coupling": 15, "knowledge-silo": 10, "versioning-candidate": 10}
#: share of the risk that mending takes away (fixed values)
REDUCTION = {"bug-prone": 0.7, "circular": 0.7, "fat-fanout": 0.7, "hot-churn": 0.5, "hidden-coupling": 0.5, "versioning-candidate": 0.5, "knowledge-silo": 0.3}
SEVERITY = {"bug-prone": 3.0, "circular": 3.0, "hot-churn": 2.0, "fat-fanout": 2.0, "hidden-coupling": 2.0, "versioning-candidate": 2.0, "knowledge-silo": 1.0}
#: files that are made to import much (fixed values)
BARREL = r"(?:^|/)index\.(?:ts|tsx|js|jsx|mjs|cjs)$"
ASSEMBLY = r"(?:^|/)App\.tsx$|(?:^|/)pages/.*Page\.tsx$|(?:^|/)apiRoutes\.ts$"
HIDDEN_COUPLING_LEAST = 10


def roi(rule: str):
    """Expected reduction of risk over effort: loc and importers, ten at least."""
    return F.round(F.col("risk") * (REDUCTION[rule] * SEVERITY[rule]) / F.greatest(F.col("loc") + 3 * F.col("fan_in"), F.lit(10)), 6)


def recommendations(nodes: DataFrame, fixes: DataFrame, coupling: DataFrame | None = None, edges: DataFrame | None = None, cycles: DataFrame | None = None) -> DataFrame:
    """(rule, path, measure, roi, place): the first rows of every gate, by measure, ties by path.

    coupling: a, b, n of files that change together; edges: src, dst of imports; with
    both, pairs that change together without an import are hidden coupling, listed
    under the lesser path. cycles: size, first (a path).
    """
    n = nodes.join(fixes.withColumnRenamed("n", "fixes"), "path", "left").fillna(0, ["fixes"])
    gates = [
        ("bug-prone", F.col("fixes") >= 5, F.col("fixes").cast("double")),
        ("hot-churn", (F.col("loc") > 30) & (F.col("churn") > 10 * F.col("loc")), F.round(F.col("churn") / F.col("loc"), 3)),
        (
            "fat-fanout",
            (F.col("fan_out") >= 8) & ~F.col("path").rlike(BARREL) & ~F.col("path").rlike(ASSEMBLY) & ~((F.col("loc") > 0) & (F.col("fan_out") >= 0.5 * F.col("loc"))),
            F.col("fan_out").cast("double"),
        ),
        ("knowledge-silo", F.col("author_count") >= 6, F.col("author_count").cast("double")),
        ("versioning-candidate", (F.col("lifecycle") == "Volatile") & (F.col("fan_in") >= 3) & (F.col("fixes") >= 3), F.col("fixes").cast("double")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), m.alias("measure"), roi(r).alias("roi"))) for r, c, m in gates]))
    rows = n.select("path", F.explode(found).alias("x")).select("x.rule", "path", "x.measure", "x.roi")
    priced = n.select("path", *[roi(r).alias(r) for r in ("circular", "hidden-coupling")])
    if coupling is not None and edges is not None:
        pairs = coupling.where((F.col("a") < F.col("b")) & (F.col("n") >= HIDDEN_COUPLING_LEAST))
        known = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        hidden = pairs.join(known, ["a", "b"], "left_anti").select(F.col("a").alias("path"), F.col("n").cast("double").alias("measure"))
        rows = rows.unionByName(_of(hidden, priced, "hidden-coupling"))
    if cycles is not None:
        rows = rows.unionByName(_of(cycles.select(F.col("first").alias("path"), F.col("size").cast("double").alias("measure")), priced, "circular"))
    most = F.create_map(*[F.lit(x) for kv in MAX_ROWS.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("measure"), "path"))
    return rows.withColumn("place", place).where(F.col("place") <= most[F.col("rule")])


def _of(found: DataFrame, priced: DataFrame, rule: str) -> DataFrame:
    return found.join(priced.select("path", F.col(f"`{rule}`").alias("roi")), "path", "left").select(F.lit(rule).alias("rule"), "path", "measure", F.coalesce("roi", F.lit(0.0)).alias("roi"))


def critical_files(nodes: DataFrame, dependents: DataFrame, least: int = 3, silent_changes: int = 2, limit: int = 20) -> DataFrame:
    """(path, blast_radius, fan_in, change_count, loc, author_count, silent): what most files depend on, directly or not.

    dependents: node, dependents (transitive). Ranked by radius * ln(loc + 2), then radius, then path.
    """
    d = dependents.select(F.col("node").alias("path"), F.col("dependents").alias("blast_radius")).where(F.col("blast_radius") >= least)
    rows = nodes.join(d, "path").withColumn("silent", F.col("change_count") <= silent_changes)
    weight = F.col("blast_radius") * F.log(F.col("loc") + 2.0)
    top = rows.orderBy(weight.desc(), F.desc("blast_radius"), "path").limit(limit)
    return top.select("path", "blast_radius", "fan_in", "change_count", "loc", "author_count", "silent")


def escalated(advice: DataFrame, critical_paths: DataFrame) -> DataFrame:
    """Moves the rows whose path has a critical finding into one group of their own."""
    hit = critical_paths.select("path").distinct().withColumn("hit", F.lit(True))
    return advice.join(hit, "path", "left").withColumn("rule", F.when(F.col("hit"), "escalated").otherwise(F.col("rule"))).drop("hit")


def dead_candidates(degrees: DataFrame, stats: DataFrame, entry: str) -> DataFrame:
    """Nodes nobody imports that import something, are no entry, and changed three times at most. entry: a regex of paths."""
    d = degrees.where((F.col("fan_in") == 0) & (F.col("fan_out") > 0)).withColumnRenamed("node", "path")
    return d.where(~F.col("path").rlike(entry)).join(stats.select("path", "change_count"), "path", "left").where(F.coalesce("change_count", F.lit(0)) <= 3).select("path", "fan_out")


def transitions(events: DataFrame) -> DataFrame:
    """(src, dst): each user's steps from one event type to the next, as a call graph."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.withColumn("dst", F.lead("event_type").over(w)).where("dst IS NOT NULL").groupBy(F.col("event_type").alias("src"), "dst").agg(F.count("*").alias("n"))
