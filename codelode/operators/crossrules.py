"""Rules over linked trees: sensitive response fields, retried writes, shadowed routes across trees, silent sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S

#: names of fields that should not leave a service, without case and separators (fixed values)
SENSITIVE_PARTS = ["password", "passwd", "secret", "apikey", "privatekey", "credential", "passphrase", "salt"]
SENSITIVE_NAMES = ["token", "jwt", "hash", "pwd", "ssn", "otp"]
SENSITIVE_ENDS = ["token"]


def sensitive_fields(responses: DataFrame, used: DataFrame) -> DataFrame:
    """(source, key, field, consumed): response fields of sensitive names; graver where some edge consumes the key. responses: source, key, field."""
    n = F.lower(F.regexp_replace("field", "[_-]", ""))
    hit = n.rlike("|".join(SENSITIVE_PARTS)) | n.isin(*SENSITIVE_NAMES) | n.rlike("(" + "|".join(SENSITIVE_ENDS) + ")$")
    keys = used.select("key").distinct().withColumn("consumed", F.lit(True))
    return responses.where(hit).select("source", "key", "field").distinct().join(keys, "key", "left").select("source", "key", "field", F.coalesce("consumed", F.lit(False)).alias("consumed"))


def retried_writes(edges: DataFrame, guarded: DataFrame) -> DataFrame:
    """Edges of write verbs whose call is retried and whose route isn't guarded. edges: key, retry_configured; guarded: key."""
    e = edges.where(F.col("retry_configured") & S.verb(F.col("key")).isin("POST", "PUT", "PATCH", "DELETE"))
    return e.join(guarded.select("key").distinct(), "key", "left_anti")


def shadowed_across(provides: DataFrame) -> DataFrame:
    """(source, key, by_source, by_key): literal routes that a pattern of another source also matches, verb and length equal.

    Each literal route is blanked at the places of each pattern mask of its verb and
    length; masks are few, so this is an equi-join.
    """
    s = S.segments(F.col("key"))
    p = provides.where((F.col("kind") == "http") & ~S.is_wildcard(F.col("key")) & S.carries_identity(F.col("key")) & (F.size(s) > 0))
    p = p.select("source", "key", S.verb(F.col("key")).alias("verb"), s.alias("s"), F.size(s).alias("n")).distinct()
    holes = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.get(F.col("s"), i) == "{}")
    pattern = p.withColumn("holes", holes).where(F.size("holes") > 0).withColumn("k", F.array_join("s", "/"))
    literal = p.where(~F.exists("s", lambda x: x == "{}"))
    masks = pattern.select("verb", "n", "holes").distinct()
    blanked = literal.join(masks, ["verb", "n"]).withColumn("k", F.array_join(F.transform("s", lambda x, i: F.when(F.array_contains("holes", i), F.lit("{}")).otherwise(x)), "/"))
    met = blanked.select("source", "key", "verb", "n", "holes", "k").join(
        pattern.select(F.col("source").alias("by_source"), F.col("key").alias("by_key"), "verb", "n", "holes", "k"), ["verb", "n", "holes", "k"]
    )
    return met.where(F.col("source") != F.col("by_source")).select("source", "key", "by_source", "by_key")


def silent_sources(mentions: DataFrame, facts: DataFrame, least: int = 3) -> DataFrame:
    """(source, files): sources whose text mentions what facts should come of in `least` files or more, and which have none.

    mentions: source, path; facts: source.
    """
    m = mentions.groupBy("source").agg(F.count_distinct("path").alias("files")).where(F.col("files") >= least)
    return m.join(facts.select("source").distinct(), "source", "left_anti")
