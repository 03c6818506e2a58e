"""The life of findings: current rows, overrides, suppression, census, order, comparison of runs.

findings: finding_id, source, rule_id, severity, file, line, message, evidence_paths, found_at, ingested_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S

ORDER = ("severity_rank", "file", "line", "rule_id", "finding_id")


def current(findings: DataFrame) -> DataFrame:
    """One row per finding_id: the earliest ingest, ties by content. Content of re-ingests is equal."""
    cols = [c for c in findings.columns if c not in ("finding_id", "ingested_at")]
    first = findings.where(F.col("finding_id").isNotNull()).groupBy("finding_id").agg(F.min(F.struct("ingested_at", *cols)).alias("s"), F.count("*").alias("ingests"))
    return first.select("finding_id", "s.*", "ingests")


def normalised(findings: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Severity in one spelling, remapped per rule, with its rank; lines below 1 are null."""
    s = F.lower(F.trim("severity"))
    for rule, to in (overrides or {}).items():
        s = F.when(F.col("rule_id") == rule, F.lit(to)).otherwise(s)
    out = findings.withColumn("severity", s).withColumn("line", F.when(F.col("line") >= 1, F.col("line")))
    return out.withColumn("severity_rank", S.severity_rank(F.col("severity")))


def suppressed(findings: DataFrame, globs: list[str] = (), rules: list[str] = ()) -> DataFrame:
    """Without the files under the globs and the rules that are off."""
    out = findings
    if globs:
        out = out.where(~F.coalesce(F.col("file").rlike("|".join(S.glob_to_regex(g) for g in globs)), F.lit(False)))
    return out.where(~F.coalesce(F.col("rule_id").isin(list(rules)), F.lit(False))) if rules else out


def redacted(findings: DataFrame, globs: list[str]) -> DataFrame:
    """Evidence paths without those under the globs."""
    p = "|".join(S.glob_to_regex(g) for g in globs)
    return findings.withColumn("evidence_paths", F.filter("evidence_paths", lambda x: ~x.rlike(p)))


def census(findings: DataFrame) -> DataFrame:
    """Totals by severity and by rule, and over all."""
    return findings.rollup("severity", "rule_id").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def top(findings: DataFrame, least: str = "info", limit: int = 50) -> DataFrame:
    """The gravest findings in their fixed order; a report of at most 1000 rows."""
    rank = S.SEVERITIES.index(least)
    return findings.where(F.col("severity_rank") <= rank).orderBy(*[F.asc_nulls_last(c) for c in ORDER]).limit(min(limit, 1000))


def subsumed(findings: DataFrame, aggregates: DataFrame, keys: list[str]) -> DataFrame:
    return findings.join(aggregates.select(*keys).distinct(), keys, "left_anti")


def compare(before: DataFrame, after: DataFrame, identity: list[str]) -> DataFrame:
    """(identity, change): what was added and what removed, by identity; null equals null."""
    marks = before.select(*identity, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*identity, F.lit(0).alias("b"), F.lit(1).alias("a")))
    g = marks.groupBy(*identity).agg(F.max("b").alias("b"), F.max("a").alias("a")).where(F.col("a") != F.col("b"))
    return g.select(*identity, F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"))


def blind_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources that had rows and have none now."""
    return before.select("source").distinct().join(after.select("source").distinct(), "source", "left_anti").where(F.col("source").isNotNull())


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in cols if c not in order])).alias("s")).select(*keys, "s.*")


def bucket_query(buckets: DataFrame, pattern: str) -> DataFrame:
    """The verdict over a substring of keys: the single bucket that matches, `mixed`, or `not-found`. buckets: join_key, bucket."""
    hit = buckets.where(F.lower("join_key").contains(pattern.lower()))
    g = hit.agg(F.count_distinct("bucket").alias("n"), F.min("bucket").alias("one"), F.count("*").alias("matches"))
    return g.select(F.lit(pattern).alias("pattern"), F.when(F.col("n") == 0, "not-found").when(F.col("n") == 1, F.col("one")).otherwise("mixed").alias("verdict"), "matches")


def nearest_keys(keys: DataFrame, pattern: str, top_n: int = 10) -> DataFrame:
    """Keys whose least edit distance to the pattern, whole or by segment, is at most half its length: the nearest ten."""
    most = max(len(pattern) // 2, 1)
    k = keys.select("key").distinct()
    whole = F.levenshtein(F.col("key"), F.lit(pattern))
    by = F.array_min(F.transform(F.split("key", "[ /]+"), lambda s: F.levenshtein(s, F.lit(pattern))))
    return k.withColumn("distance", F.least(whole, by)).where(F.col("distance") <= most).orderBy("distance", "key").limit(top_n)


def enum_drift(rows: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """Values outside a declared enumeration, and declared ones that never occur."""
    seen = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    d = spark.createDataFrame([(x,) for x in declared], "value string")
    both = seen.join(d.withColumn("declared", F.lit(True)), "value", "full_outer").fillna({"n": 0, "declared": False})
    return both.where((F.col("n") == 0) | ~F.col("declared"))


def unreferenced(names: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Names that occur in no text as a whole word. names: name."""
    tokens = texts.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(\w+)"), F.lit(1)))).alias("name")).distinct()
    return names.select("name").where(F.length("name") >= 3).distinct().join(tokens, "name", "left_anti")
