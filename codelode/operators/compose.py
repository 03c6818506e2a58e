"""Joins that rewrite keys when trees are put together: constants, prefixes, mounts, wrappers, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.session import cut


def first_writer(constants: DataFrame) -> DataFrame:
    """(source, name, value): of several writers of a name the first by path counts. constants: source, name, path, value."""
    g = constants.groupBy("source", "name").agg(F.min(F.struct("path", "value")).alias("s"))
    return g.select("source", "name", "s.value")


def late_consumes(consumes: DataFrame, constants: DataFrame) -> DataFrame:
    """Consumes without a key whose `raw` names a constant get its value as key."""
    c = first_writer(constants).withColumnRenamed("name", "raw")
    return consumes.join(c, ["source", "raw"], "left").withColumn("key", F.coalesce("key", F.when(F.col("value").isNotNull(), S.http_consume_key(F.coalesce("method", F.lit("GET")), F.col("value"))))).drop("value")


def join_path(prefix: Column, key: Column) -> Column:
    """The key with a prefix before its path, one slash between; an empty prefix adds nothing."""
    p = F.regexp_replace(prefix, "/+$", "")
    return F.when(F.coalesce(p, F.lit("")) == "", key).otherwise(S.http_key(S.verb(key), F.concat(p, F.lit("/"), S.path_of(key))))


def global_prefix(provides: DataFrame, markers: DataFrame) -> DataFrame:
    """A source's http provides get its global prefix if it states exactly one. markers: source, prefix."""
    one = markers.groupBy("source").agg(F.count_distinct("prefix").alias("n"), F.min("prefix").alias("prefix")).where("n = 1").drop("n")
    return provides.join(one, "source", "left").withColumn("key", F.when(F.col("kind") == "http", join_path(F.col("prefix"), F.col("key"))).otherwise(F.col("key"))).drop("prefix")


def conflicting_prefixes(markers: DataFrame) -> DataFrame:
    return markers.groupBy("source").agg(F.count_distinct("prefix").alias("n")).where("n > 1")


def config_mounts(provides: DataFrame, mounts: DataFrame) -> DataFrame:
    """The prefix of the longest folder that holds a provide's file. mounts: source, dir, prefix."""
    parts = F.split("file", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys = provides.select("source", "file").distinct().withColumn("dir", F.explode(dirs))
    best = keys.join(mounts, ["source", "dir"]).groupBy("source", "file").agg(F.max_by("prefix", F.length("dir")).alias("prefix"))
    return provides.join(best, ["source", "file"], "left").withColumn("key", join_path(F.col("prefix"), F.col("key"))).drop("prefix")


def router_mounts(routes: DataFrame, mounts: DataFrame, roots: DataFrame) -> DataFrame:
    """(router, key): routes under every chain of mounts from a root. routes: router, key; mounts: parent, child, prefix; roots: router.

    A router is not mounted under itself again, so cycles end, and with them the rounds.
    """
    seen = cut(roots.select("router").distinct().select("router", F.lit("").alias("prefix"), F.array("router").alias("chain")))
    frontier = seen
    while True:
        step = frontier.join(mounts.withColumnRenamed("prefix", "own"), F.col("router") == F.col("parent")).where(~F.array_contains("chain", F.col("child")))
        step = cut(step.select(F.col("child").alias("router"), F.concat(F.col("prefix"), F.lit("/"), F.col("own")).alias("prefix"), F.concat(F.col("chain"), F.array("child")).alias("chain")))
        if step.isEmpty():
            break
        seen = cut(seen.unionByName(step))
        frontier = step
    return routes.join(seen, "router").select("router", join_path(F.col("prefix"), F.col("key")).alias("key")).distinct()


def wrapper_consumes(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls of wrapper functions as consumes. definitions: callee, verb_arg, path_arg (0-based, verb may be fixed); calls: source, file, line, callee, args."""
    j = calls.join(definitions, "callee")
    verb = F.coalesce("fixed_verb", F.get("args", F.col("verb_arg")))
    path = F.get("args", F.col("path_arg"))
    return j.where(path.isNotNull() & verb.isNotNull()).select("source", "file", "line", S.http_consume_key(verb, path).alias("key"))


def shapes(fields: DataFrame) -> DataFrame:
    """(name, shape): DTO names with one shape; names declared with differing shapes are poisoned. fields: decl, name, field, optional."""
    d = fields.groupBy("decl", "name").agg(F.sort_array(F.collect_set(F.struct("field", "optional"))).alias("shape"))
    return d.groupBy("name").agg(F.count_distinct("shape").alias("n"), F.first("shape").alias("shape")).where("n = 1").drop("n")


def body_drift(edges: DataFrame, dto: DataFrame) -> DataFrame:
    """(key, missing, undeclared): fields an edge's body lacks or has in excess. edges: key, body_keys, complete, dto_ref; dto: name, shape."""
    j = edges.join(dto.withColumnRenamed("name", "dto_ref"), "dto_ref")
    required = F.transform(F.filter("shape", lambda s: ~s["optional"]), lambda s: s["field"])
    every = F.transform("shape", lambda s: s["field"])
    missing = F.when(F.col("complete"), F.array_except(required, F.col("body_keys"))).otherwise(F.array().cast("array<string>"))
    out = j.select("key", F.sort_array(missing).alias("missing"), F.sort_array(F.array_except("body_keys", every)).alias("undeclared"))
    return out.where((F.size("missing") > 0) | (F.size("undeclared") > 0)).distinct()
