"""The import graph: degrees, cycles, closure, reach, diamonds and the projections by folder.

edges: src, dst. Iterative operators cut their lineage in the shared folder each
round, and hold one row per node or frontier entry; nothing is collected but counts.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.session import cut


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) over distinct edges."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def _rounds(most: int | None):
    """Counts without end, or fails after `most` rounds."""
    for n in count():
        if most is not None and n >= most:
            raise RuntimeError(f"not settled after {most} rounds")
        yield n


def _spread(colour: DataFrame, edges: DataFrame, most: int | None) -> DataFrame:
    """Each node's least colour among the nodes that reach it. colour: node, c; edges: src, dst."""
    for _ in _rounds(most):
        met = edges.join(colour.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("n"))
        step = colour.join(met, "node", "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("moved"))
        step = cut(step)
        colour = step.select("node", "c")
        if step.where("moved").isEmpty():
            break
    return colour


def scc(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, component): the strongly connected component of each node on a cycle, named by its least member.

    Colouring: nodes without an edge in or out are trimmed; each node gets the least
    node that reaches it; within a colour, what reaches the colour's root is its
    component. Components leave the graph, and the rest goes on until none is left;
    with most_rounds, more rounds than that are an error.
    """
    left = cut(edges.select("src", "dst").distinct())
    found = left.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))  # self-loops, unless a larger one holds them
    parts = []
    left = left.where("src <> dst")
    for _ in _rounds(most_rounds):
        while True:  # trim
            kept = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct()
        colour = _spread(nodes.withColumn("c", F.col("node")), left, most_rounds)
        inner = left.join(colour.withColumnRenamed("node", "src").withColumnRenamed("c", "cs"), "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("c", "cd"), "dst").where("cs = cd")
        inner = cut(inner.select("src", "dst", F.col("cs").alias("c")))
        # back from each root within its colour
        reached = cut(colour.where("node = c").select("node", "c"))
        frontier = reached
        while True:
            new = inner.join(frontier.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            new = cut(new.join(reached, ["node", "c"], "left_anti"))
            if new.isEmpty():
                break
            reached = cut(reached.unionByName(new))
            frontier = new
        sizes = reached.groupBy("c").agg(F.count("*").alias("size"))
        parts.append(cut(reached.join(sizes.where("size > 1"), "c").select("node", F.col("c").alias("component"))))
        gone = reached.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    out = found
    if parts:
        members = parts[0]
        for p in parts[1:]:
            members = members.unionByName(p)
        out = members.unionByName(found.join(members.select("node"), "node", "left_anti"))
    return out


def cycles(components: DataFrame) -> DataFrame:
    """(component, size, first, all_test): one row per cycle."""
    return components.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("first"))


def reach(edges: DataFrame, starts: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(start, node, depth): what each start reaches, at its least depth; a start reaches itself at depth 0."""
    e = cut(edges.select("src", "dst").distinct())
    seen = cut(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        new = frontier.join(e.withColumnRenamed("src", "node"), "node").select("start", F.col("dst").alias("node")).distinct()
        new = cut(new.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
        frontier = new
    return seen


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node): everything that any entry reaches, entries included; one row per node is held."""
    e = cut(edges.select("src", "dst").distinct())
    seen = cut(entries.select("node").distinct())
    frontier = seen
    while True:
        new = cut(frontier.join(e.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new))
        frontier = new


def unreachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, fan_in): imported by something, yet not reached from any entry (or node without importers)."""
    d = degrees(edges)
    start = entries.select("node").unionByName(d.where("fan_in = 0").select("node")).distinct()
    return d.where("fan_in > 0").join(reachable(edges, start), "node", "left_anti").select("node", "fan_in")


def dependents(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, dependents): how many nodes reach a node, itself aside; within `depth` steps if given."""
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = edges.select(F.col("dst").alias("node")).distinct()
    return reach(reverse, nodes, depth).where("depth > 0").groupBy(F.col("start").alias("node")).agg(F.count("*").alias("dependents"))


def diamonds(edges: DataFrame) -> DataFrame:
    """(root, leaf, mids): two ways or more from root to leaf over one intermediate, and no direct one."""
    e = edges.select("src", "dst").distinct().where("src <> dst")
    two = e.select(F.col("src").alias("root"), F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), F.col("dst").alias("leaf")), "mid").where("root <> leaf")
    g = two.groupBy("root", "leaf").agg(F.count_distinct("mid").alias("mids")).where("mids >= 2")
    return g.join(e.select(F.col("src").alias("root"), F.col("dst").alias("leaf")), ["root", "leaf"], "left_anti")


def folder_edges(edges: DataFrame, depth: int) -> DataFrame:
    """Edges between folders, with counts; within one folder they are left out."""
    f = edges.select(S.folder_of(F.col("src"), depth).alias("from_folder"), S.folder_of(F.col("dst"), depth).alias("to_folder"))
    return f.where("from_folder <> to_folder").groupBy("from_folder", "to_folder").agg(F.count("*").alias("n"))


def seams(edges: DataFrame, nodes: DataFrame, temporal: DataFrame, depth: int = 1, least: int = 3, top: int = 15) -> DataFrame:
    """Folders by internal / (boundary + temporal + 1). temporal: a, b paths that change together."""
    f = lambda c: S.folder_of(F.col(c), depth)
    files = nodes.groupBy(f("path").alias("folder")).agg(F.count("*").alias("files")).where(F.col("files") >= least)
    e = edges.select(f("src").alias("a"), f("dst").alias("b"))
    inner = e.where("a = b").groupBy(F.col("a").alias("folder")).agg(F.count("*").alias("internal"))
    ends = e.where("a <> b")
    out = ends.groupBy(F.col("a").alias("folder")).agg(F.count("*").alias("out_edges"))
    into = ends.groupBy(F.col("b").alias("folder")).agg(F.count("*").alias("in_edges"))
    t = temporal.select(f("a").alias("x"), f("b").alias("y")).where("x <> y")
    t = t.select(F.explode(F.array("x", "y")).alias("folder")).groupBy("folder").agg(F.count("*").alias("temporal"))
    s = files
    for part in (inner, out, into, t):
        s = s.join(part, "folder", "left")
    s = s.fillna(0)
    score = F.col("internal") / (F.col("in_edges") + F.col("out_edges") + F.col("temporal") + 1)
    return s.withColumn("score", F.round(score, 4)).orderBy(F.desc("score"), "folder").limit(top)
