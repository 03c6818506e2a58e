"""Why a consume found no provider: verbs, versions, cases, prefixes and placeholders.

Every rule is an equi-join on a key derived from both sides, so no rule compares
all misses with all provides. misses: id, source, join_key; provides: source, key, file, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S


def _provided(provides: DataFrame) -> DataFrame:
    p = provides.where((F.col("kind") == "http") & ~S.is_wildcard(F.col("key")))
    return p.select(
        F.struct("source", "file", "line", "key").alias("provider"), F.col("key").alias("p_key"), S.verb(F.col("key")).alias("p_verb"), S.path_of(F.col("key")).alias("p_path"),
    )


def _best(hits: DataFrame) -> DataFrame:
    """Of a miss's candidates the least by (source, file, line), and how many more there are."""
    return hits.groupBy("id").agg(F.min("provider").alias("m"), (F.count("*") - 1).alias("others")).select(
        "id", F.col("m.source").alias("provide_source"), F.col("m.key").alias("provide_key"), "others"
    )


def method_mismatch(misses: DataFrame, provides: DataFrame) -> DataFrame:
    """The path is provided, under another verb."""
    m = misses.select("id", S.verb(F.col("join_key")).alias("verb"), S.path_of(F.col("join_key")).alias("p_path"))
    return _best(m.join(_provided(provides), "p_path").where(F.col("verb") != F.col("p_verb")))


def _without_version(key: Column) -> Column:
    """The key with its only version segment blanked; null if there are none or several."""
    s = F.split(S.path_of(key), "/")
    n = F.size(F.filter(s, S.is_version))
    return F.when(n == 1, F.concat(S.verb(key), F.lit(" "), F.array_join(F.transform(s, lambda x: F.when(S.is_version(x), F.lit("<v>")).otherwise(x)), "/")))


def version_skew(misses: DataFrame, provides: DataFrame) -> DataFrame:
    """Equal but for one version segment."""
    m = misses.select("id", "join_key", _without_version(F.col("join_key")).alias("k"))
    p = _provided(provides).withColumn("k", _without_version(F.col("p_key")))
    return _best(m.join(p, "k").where(F.col("join_key") != F.col("p_key")))


def case_miss(misses: DataFrame, provides: DataFrame) -> DataFrame:
    m = misses.select("id", "join_key", F.lower("join_key").alias("k"))
    p = _provided(provides).withColumn("k", F.lower("p_key"))
    return _best(m.join(p, "k").where(F.col("join_key") != F.col("p_key")))


def _stripped(key: Column) -> Column:
    """(prefix, rest) with 1 and 2 leading segments taken off, while something remains."""
    s = S.segments(key)
    return F.filter(
        F.array(
            *[
                F.struct(F.array_join(F.slice(s, 1, n), "/").alias("prefix"), F.concat(S.verb(key), F.lit(" /"), F.array_join(F.slice(s, F.lit(n + 1), F.greatest(F.size(s) - n, F.lit(0))), "/")).alias("k"), (F.size(s) > n).alias("left"),
                         F.exists(F.slice(s, 1, n), lambda x: x == "{}").alias("hole"))
                for n in (1, 2)
            ]
        ),
        lambda x: x["left"] & ~x["hole"],
    )


def prefix_miss(misses: DataFrame, provides: DataFrame) -> DataFrame:
    """Every (miss, provide) equal but for one or two leading literal segments: id, source, prefix, missing, provider.

    missing: the consume lacks the prefix; otherwise it has it in excess.
    """
    m = misses.where(F.col("join_key").isNotNull() & S.carries_identity(F.col("join_key"))).select("id", "source", "join_key")
    p = _provided(provides).where(S.carries_identity(F.col("p_key")))
    lacking = m.withColumn("k", F.col("join_key")).join(p.select("provider", F.explode(_stripped(F.col("p_key"))).alias("x")).select("provider", "x.prefix", "x.k"), "k")
    excess = m.select("id", "source", F.explode(_stripped(F.col("join_key"))).alias("x")).select("id", "source", "x.prefix", "x.k").join(p.select("provider", F.col("p_key").alias("k")), "k")
    cols = ["id", "source", "prefix", "provider"]
    return lacking.select(*cols).withColumn("missing", F.lit(True)).unionByName(excess.select(*cols).withColumn("missing", F.lit(False)))


def prefix_drift(prefix_misses: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of trees whose misses share one prefix."""
    g = prefix_misses.select("source", F.col("provider.source").alias("provide_source"), "prefix", "missing", "id")
    return g.groupBy("source", "provide_source", "prefix", "missing").agg(F.count_distinct("id").alias("consumes")).where(F.col("consumes") >= least)


def route_near_miss(misses: DataFrame, provides: DataFrame) -> DataFrame:
    """Case-fold candidates first; only for those without, prefix candidates."""
    by_case = case_miss(misses, provides)
    rest = misses.join(by_case.select("id"), "id", "left_anti")
    by_prefix = _best(prefix_miss(rest, provides))
    return by_case.withColumn("how", F.lit("case")).unionByName(by_prefix.withColumn("how", F.lit("prefix")))


def path_near_miss(misses: DataFrame, provides: DataFrame) -> DataFrame:
    """Same verb and length, each segment equal or a placeholder on either side, keys not equal.

    Both sides are blanked at the other's possible placeholder places: keys with
    placeholders are few, so a side with none is joined by the places the other has.
    """

    def shaped(df: DataFrame, key: str, side: str) -> DataFrame:
        s = S.segments(F.col(key))
        holes = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i) == "{}")
        return df.where(S.carries_identity(F.col(key)) & (F.size(s) > 0)).withColumn(f"{side}s", s).withColumn(f"{side}holes", holes).withColumn("verb", S.verb(F.col(key))).withColumn("n", F.size(s))

    m = shaped(misses.select("id", "join_key"), "join_key", "c")
    p = shaped(_provided(provides), "p_key", "p")
    # the distinct placeholder masks of either side, a table as small as the shapes of keys
    masks_c = m.select("verb", "n", "choles").distinct()
    masks_p = p.select("verb", "n", "pholes").distinct()

    def blanked(s: Column, holes: Column) -> Column:
        return F.array_join(F.transform(s, lambda x, i: F.when(F.array_contains(holes, i), F.lit("{}")).otherwise(x)), "/")

    both = F.array_union(F.col("choles"), F.col("pholes"))
    left = m.join(masks_p, ["verb", "n"]).withColumn("k", blanked(F.col("cs"), both))
    right = p.join(masks_c, ["verb", "n"]).withColumn("k", blanked(F.col("ps"), both))
    hits = left.join(right, ["verb", "n", "choles", "pholes", "k"]).where(F.col("join_key") != F.col("p_key"))
    return _best(hits.select("id", "provider"))
