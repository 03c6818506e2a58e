"""Aggregates over provides and consumes: duplicates, hosts, versions, ratios, shadowing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import scalars as S


def duplicate_sources(provides: DataFrame) -> DataFrame:
    """(key, source, n_sources, sites): one row per source of a route that two sources or more provide."""
    p = provides.where((F.col("kind") == "http") & ~S.is_wildcard(F.col("key")))
    by_source = p.groupBy("key", "source").agg(F.count("*").alias("sites"))
    many = by_source.groupBy("key").agg(F.count("*").alias("n_sources")).where(F.col("n_sources") >= 2)
    return by_source.join(many, "key")


def external(rekeyed: DataFrame) -> DataFrame:
    return rekeyed.where(F.col("is_external")).withColumn("h", S.url_host(F.col("key"))).withColumn("path", S.url_path(F.col("key"))).where(F.col("h") != "")


def external_shadows_internal(rekeyed: DataFrame, provides: DataFrame) -> DataFrame:
    """External calls whose path some tree provides itself."""
    x = external(rekeyed).select("id", "source", F.col("h").alias("host"), S.http_consume_key(S.verb(F.col("key")), F.col("path")).alias("key"))
    return x.join(provides.select("key", F.col("source").alias("provide_source")), "key").select("id", "source", "host", "key", "provide_source")


def host_fanout(rekeyed: DataFrame) -> DataFrame:
    """Hosts called by two sources or more, or from three files or more."""
    g = external(rekeyed).groupBy(F.col("h").alias("host")).agg(
        F.count_distinct("source").alias("sources"), F.count_distinct("source", "file").alias("files"), F.count("*").alias("calls")
    )
    return g.where((F.col("sources") >= 2) | (F.col("files") >= 3))


def ip_literals(rekeyed: DataFrame) -> DataFrame:
    """Calls to a raw address, loopback aside."""
    return external(rekeyed).where(S.is_ip(F.col("h")) & ~F.col("h").startswith("127.")).select("id", "source", F.col("h").alias("host"))


def base_url_drift(rekeyed: DataFrame) -> DataFrame:
    """Paths called at two hosts or more of one registrable domain; paths need two segments, not all placeholders."""
    s = F.filter(F.split("path", "/"), lambda x: x != "")
    x = external(rekeyed).where((F.size(s) >= 2) & F.exists(s, lambda v: v != "{}"))
    g = x.groupBy("path", S.registrable_domain(F.col("h")).alias("domain")).agg(
        F.count_distinct("h").alias("hosts"), F.min("h").alias("first_host"), F.count("*").alias("calls")
    )
    return g.where(F.col("hosts") >= 2)


def version_inconsistency(rekeyed: DataFrame) -> DataFrame:
    """Hosts with paths that name a version and paths that name none; paths without a literal segment say nothing."""
    s = F.filter(F.split("path", "/"), lambda v: v != "")
    x = external(rekeyed).where(F.exists(s, lambda v: v != "{}")).withColumn("versioned", F.exists(s, S.is_version))
    g = x.groupBy(F.col("h").alias("host")).agg(
        F.count_distinct(F.when(F.col("versioned"), F.col("path"))).alias("versioned"), F.count_distinct(F.when(~F.col("versioned"), F.col("path"))).alias("plain"),
        F.count_distinct("source").alias("sources"),
    )
    return g.where((F.col("versioned") > 0) & (F.col("plain") > 0))


def unresolved_ratio(classified: DataFrame, least: int = 5) -> DataFrame:
    g = classified.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("bucket") == "unresolved").alias("unresolved"))
    return g.where(F.col("total") >= least).withColumn("majority", 2 * F.col("unresolved") >= F.col("total"))


def unjoined_sources(classified: DataFrame) -> DataFrame:
    return classified.groupBy("source").agg(
        F.count_if(F.col("bucket").isin("unprovided", "ambiguous")).alias("waiting"), F.count_if(F.col("bucket") == "edge").alias("joined")
    )


def capped(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each group, with the number folded away behind them.

    A limit per group: Spark keeps only the first rows of a group before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    total = rows.groupBy(group).agg(F.count("*").alias("total"))
    kept = rows.select(group, *order).withColumn("place", place).where(F.col("place") <= most).drop("place")
    return kept.join(total, group).select(group, *order, F.greatest(F.col("total") - most, F.lit(0)).alias("folded"))


def shadowed_in_file(provides: DataFrame) -> DataFrame:
    """Literal routes behind an earlier route of the same file that differs in one place, where it has a placeholder."""
    s = S.segments(F.col("key"))
    p = provides.where((F.col("kind") == "http") & ~S.is_wildcard(F.col("key"))).withColumn("s", s)
    holed = p.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.get(F.col("s"), i) == "{}")))
    plain = p.where(F.size("s") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("s") - 1))).where(F.get(F.col("s"), F.col("i")) != "{}")
    blank = lambda: F.array_join(F.transform("s", lambda x, j: F.when(j == F.col("i"), F.lit("{}")).otherwise(x)), "/")
    a = holed.select("source", "file", S.verb(F.col("key")).alias("verb"), "i", blank().alias("k"), F.col("line").alias("by_line"), F.col("key").alias("by_key"))
    b = plain.select("source", "file", S.verb(F.col("key")).alias("verb"), "i", blank().alias("k"), "line", "key")
    met = a.join(b, ["source", "file", "verb", "i", "k"]).where(F.col("by_line") < F.col("line"))
    return met.groupBy("source", "file", "key", "line").agg(F.min(F.struct("by_line", "by_key")).alias("by")).select("source", "file", "key", "line", "by.by_key", "by.by_line")
