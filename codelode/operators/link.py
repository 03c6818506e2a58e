"""The join of interface consumes to provides across trees, with a bucket for every consume.

consumes: id, source, kind, key, file, line; provides: source, kind, key, file, line, symbol.

Each consume falls into exactly one bucket:
  unresolved   no key, or a key that matches nothing and has no literal segment
  external     a URL whose host is not declared as internal (a declared one is re-keyed to its path)
  edge         its key is provided by one source
  ambiguous    its key is provided by two sources or more
  wildcard     nothing provides it, but a wildcard route covers it
  unprovided   the rest
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import scalars as S

#: keys that many services share, so an edge over them says little (fixed values)
GENERIC_REASON = "generic path shared by many services (health/ping/metrics/status/login)"
GENERIC_KEYS = [
    r"^[A-Z]+ /health$",
    r"^[A-Z]+ /healthz$",
    r"^[A-Z]+ /ping$",
    r"^[A-Z]+ /metrics$",
    r"^[A-Z]+ /status$",
    r"^[A-Z]+ /login$",
    r"^[A-Z]+ /logout$",
    r"^[A-Z]+ /version$",
    r"^[A-Z]+ /favicon\.ico$",
]


def rekeyed(consumes: DataFrame, hosts: list[str]) -> DataFrame:
    """Adds join_key, host (the declared host that matched) and is_external."""
    authority, scheme = S.url_authority(F.col("key")), S.url_scheme(F.col("key"))
    bare = S.url_host(F.col("key"))
    matched = F.lit(None).cast("string")
    for h in reversed(hosts):  # the first declared host wins
        hit = F.lower(authority) == h.lower() if ":" in h else bare == h.lower()
        matched = F.when(hit & scheme.isin("http", "https"), F.lit(h)).otherwise(matched)
    # most keys are no URLs, and a search for a constant is far cheaper than a regex
    out = consumes.withColumn("host", F.when(F.col("key").contains("://"), matched))
    own = S.http_consume_key(S.verb(F.col("key")), S.url_path(F.col("key")))
    return out.withColumn("is_external", F.coalesce(F.col("key").contains("://") & F.col("host").isNull(), F.lit(False))).withColumn(
        "join_key", F.when(F.col("host").isNotNull(), own).otherwise(F.col("key"))
    )


def provider_keys(provides: DataFrame) -> DataFrame:
    """(kind, join_key, n_sources): the keys that take part in the join."""
    plain = provides.where(~((F.col("kind") == "http") & S.is_wildcard(F.col("key"))))
    return plain.groupBy("kind", F.col("key").alias("join_key")).agg(F.count_distinct("source").alias("n_sources"))


def wildcard_routes(provides: DataFrame) -> DataFrame:
    """Wildcard http routes in their fixed order: (route, source, key, file, line, verb, pattern)."""
    w = provides.where((F.col("kind") == "http") & S.is_wildcard(F.col("key")))
    return w.select("source", "key", "file", "line").withColumn("verb", S.verb(F.col("key"))).withColumn("pattern", S.path_of(F.col("key")))


def covered_by(misses: DataFrame, routes: DataFrame) -> DataFrame:
    """(join_key, route): the first route that covers each miss; misses that none covers are left out.

    Patterns are matched per distinct (verb, path); a pattern's literal lead, up to
    its first wildcard, is an equi-join key, so no miss meets every route.
    """
    lead = F.regexp_replace(F.regexp_extract("pattern", r"^/*((?:[^/*?{]+(?:/|$))*)", 1), "/$", "")
    r = routes.select(
        "verb", lead.alias("lead"), F.when(lead == "", 0).otherwise(F.size(F.split(lead, "/"))).alias("depth"), "pattern",
        F.struct(F.col("source"), F.col("key"), F.col("file"), F.col("line")).alias("route"),
    )
    r = r.groupBy("verb", "lead", "depth", "pattern").agg(F.min("route").alias("route")).withColumn("regex", _ant_regex(F.col("pattern")))
    depths = sorted(x["depth"] for x in r.select("depth").distinct().collect())  # a few small numbers
    m = misses.select("join_key").distinct().withColumn("verb", S.verb(F.col("join_key")))
    m = m.withColumn("path", F.regexp_replace(S.path_of(F.col("join_key")), "^/+", ""))
    # a covering pattern's lead is that many segments of the path
    count = F.length("path") - F.length(F.replace("path", F.lit("/"))) + 1
    leads = F.array_compact(F.array(*[F.when(count >= k, F.substring_index("path", "/", k) if k else F.lit("")) for k in depths]).cast("array<string>"))
    met = m.withColumn("lead", F.explode(leads)).join(r, ["verb", "lead"])
    return met.where(F.rlike(F.col("path"), F.col("regex"))).groupBy("join_key").agg(F.min("route").alias("route"))


def _ant_regex(pattern: Column) -> Column:
    """Column form of an ANT pattern over a path without its leading slashes."""
    segs = F.split(F.regexp_replace(pattern, "^/+", ""), "/")
    one = F.transform(
        segs,
        lambda s, i: F.when(
            s == "**",
            F.when(i == F.size(segs) - 1, F.when(i == 0, F.lit(".*")).otherwise(F.lit("(?:/.*)?"))).otherwise(
                F.when(i == 0, F.lit("(?:[^/]*/)*")).otherwise(F.lit("(?:/[^/]*)*"))
            ),
        ).otherwise(
            F.concat(
                F.when((i == 0) | ((i == 1) & (F.get(segs, F.lit(0)) == "**")), F.lit("")).otherwise(F.lit("/")),
                F.when(s.contains("*") | s.contains("?") | (s.startswith("{") & s.endswith("}")), F.lit("[^/]*")).otherwise(
                    F.concat(F.lit("\\Q"), s, F.lit("\\E"))
                ),
            )
        ),
    )
    return F.concat(F.lit("^"), F.array_join(one, ""), F.lit("$"))


def classify(consumes: DataFrame, provides: DataFrame, hosts: list[str]) -> DataFrame:
    """The consumes with host, join_key, bucket and the wildcard route that covers them."""
    keys = provider_keys(provides)
    c = rekeyed(consumes, hosts).join(keys, ["kind", "join_key"], "left")
    missed = F.col("n_sources").isNull() & F.col("join_key").isNotNull() & ~F.col("is_external")
    covers = covered_by(c.where(missed & (F.col("kind") == "http")).select("join_key"), wildcard_routes(provides))
    c = c.join(covers, "join_key", "left")
    bucket = (
        F.when(F.col("join_key").isNull(), "unresolved")
        .when(F.col("is_external"), "external")
        .when(F.col("n_sources") >= 2, "ambiguous")
        .when(F.col("n_sources") == 1, "edge")
        .when(F.col("route").isNotNull() & (F.col("kind") == "http"), "wildcard")
        .when(~S.carries_identity(F.col("join_key")), "unresolved")
        .otherwise("unprovided")
    )
    return c.withColumn("bucket", bucket)


def edges(classified: DataFrame, provides: DataFrame, low_confidence: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per provider of an edge consume's key. low_confidence: (regex, reason), the first match counts."""
    low_confidence = [(k, GENERIC_REASON) for k in GENERIC_KEYS] if low_confidence is None else low_confidence
    reason = F.coalesce(*[F.when(F.col("join_key").rlike(p), F.lit(r)) for p, r in low_confidence], F.lit(None).cast("string"))
    p = provides.select(
        "kind", F.col("key").alias("join_key"), F.col("source").alias("to_source"), F.col("file").alias("to_file"), F.col("line").alias("to_line"), "symbol"
    )
    return (
        classified.where(F.col("bucket") == "edge")
        .join(p, ["kind", "join_key"])
        .select(
            "kind", F.col("join_key").alias("key"), F.col("source").alias("from_source"), F.col("file").alias("from_file"), F.col("line").alias("from_line"),
            "to_source", "to_file", "to_line", "symbol", (F.col("source") != F.col("to_source")).alias("cross_source"), reason.alias("low_confidence_reason"),
        )
    )


def unconsumed(classified: DataFrame, provides: DataFrame) -> DataFrame:
    """Provides whose key no consume reaches, not even ambiguously; wildcard routes aside."""
    used = classified.where(F.col("bucket").isin("edge", "ambiguous")).select("kind", F.col("join_key").alias("key")).distinct()
    return provides.where(~((F.col("kind") == "http") & S.is_wildcard(F.col("key")))).join(used, ["kind", "key"], "left_anti")


def ambiguous(classified: DataFrame, provides: DataFrame, shown: int = 5) -> DataFrame:
    """Ambiguous keys with how many consumes wait for them and the first `shown` candidates."""
    n = classified.where(F.col("bucket") == "ambiguous").groupBy("kind", F.col("join_key").alias("key")).agg(F.count("*").alias("consumes"))
    place = Window.partitionBy("kind", "key").orderBy("source", "file", "line")
    p = provides.join(n.select("kind", "key"), ["kind", "key"], "left_semi").withColumn("n", F.row_number().over(place))
    seen = p.groupBy("kind", "key").agg(
        F.count("*").alias("candidates"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") <= shown, F.concat_ws(":", "source", "file", "line")))), ",").alias("shown")
    )
    return n.join(seen, ["kind", "key"])


def wildcard_partitions(classified: DataFrame, provides: DataFrame) -> DataFrame:
    """Every wildcard route with the number of consumes it swallowed."""
    n = classified.where(F.col("bucket") == "wildcard").groupBy("route").agg(F.count("*").alias("covered"))
    n = n.select("route.*", "covered")
    return wildcard_routes(provides).select("source", "key", "file", "line").join(n, ["source", "key", "file", "line"], "left").fillna(0, ["covered"])


def host_rekeys(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("consumes"))
