"""Facts parsed elsewhere: the JSON envelope, its checks, its relations, and overlays on native rows.

An envelope is one JSON object: format, version, parser, source and files, each
with path, loc, symbols, imports and io (provides, consumes). It is read with a
fixed schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT, VERSION = "normalized-facts", "2.0.0"
SCHEMA = """format string, version string, parser string, source string, files array<struct<path:string, loc:int,
  symbols:array<struct<id:string,name:string,kind:string,line:int,exported:boolean,bodyStart:int,bodyEnd:int,body_start:int,body_end:int>>,
  imports:map<string,struct<specifier:string,original:string,deferred:boolean,type_only:boolean>>,
  re_exports:array<struct<specifier:string,original:string,local_alias:string,type_only:boolean>>, used_names:array<string>,
  calls:array<struct<from_symbol:string,callee_name:string,line:int,receiver_type:string>>,
  io:struct<provides:array<struct<kind:string,key:string,line:int,symbol:string,response:struct<fields:array<struct<name:string,optional:boolean>>,complete:boolean>>>,
    consumes:array<struct<kind:string,key:string,line:int,raw:string,method:string,client:string>>>,
  degraded:boolean, overrides:array<string>>>"""


def parse(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(k, e): the envelopes; e is null for text that is no JSON object of that shape."""
    return texts.select(F.col(f"`{key}`").alias("k"), F.from_json(F.col(f"`{text}`"), SCHEMA).alias("e"))


def _parts(version: Column) -> Column:
    """The three numbers of a version, missing ones 0; null if it is none."""
    v = F.split(version, "[.]").cast("array<int>")
    numbers = F.array(*[F.coalesce(F.get(v, F.lit(i)), F.lit(0)) for i in range(3)])
    return F.when(version.rlike(r"^[0-9]{1,9}([.][0-9]{1,9}){0,2}$"), numbers)


def issues(parsed: DataFrame, formats: tuple[str, ...] = (FORMAT,), newest: str = VERSION) -> DataFrame:
    """(k, issue): why an envelope isn't valid; valid ones give no row. Versions are text, compared number by number."""
    paths = F.transform(F.coalesce("e.files", F.array()), lambda f: f["path"])
    spans = F.flatten(F.transform(F.coalesce("e.files", F.array()), lambda f: F.coalesce(f["symbols"], F.array())))
    readable = F.col("e.format").isNotNull()
    version = _parts(F.col("e.version"))
    found = [
        F.when(F.col("e").isNull() | ~readable, "unreadable"),
        F.when(~F.col("e.format").isin(*formats), "wrong-format"),
        F.when(version.isNull() & readable, "malformed-version"),
        F.when(version > _parts(F.lit(newest)), "newer-version"),
        F.when(F.exists(paths, lambda p: p.isNull() | (p == "")), "empty-path"),
        F.when(F.size(F.array_distinct(paths)) < F.size(paths), "duplicate-path"),
        F.when(F.exists(spans, lambda s: F.coalesce(s["bodyEnd"], s["body_end"]) < F.coalesce(s["bodyStart"], s["body_start"])), "body-ends-before-start"),
    ]
    return parsed.select("k", F.explode(F.array_compact(F.array(*found))).alias("issue"))


def _files(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("e.source").alias("source"), F.col("e.parser").alias("parser"), F.explode("e.files").alias("f"))


def files(parsed: DataFrame) -> DataFrame:
    return _files(parsed).select("source", "parser", "f.path", "f.loc")


def symbols(parsed: DataFrame) -> DataFrame:
    return _files(parsed).select("source", "parser", F.col("f.path").alias("file"), F.explode("f.symbols").alias("s")).select(
        "source", "parser", "file", "s.id", "s.name", "s.kind", "s.line", "s.exported", F.coalesce("s.bodyStart", "s.body_start").alias("body_start"), F.coalesce("s.bodyEnd", "s.body_end").alias("body_end")
    )


def provides(parsed: DataFrame) -> DataFrame:
    return _files(parsed).select("source", "parser", F.col("f.path").alias("file"), F.explode("f.io.provides").alias("p")).select("source", "parser", "file", "p.*")


def consumes(parsed: DataFrame) -> DataFrame:
    return _files(parsed).select("source", "parser", F.col("f.path").alias("file"), F.explode("f.io.consumes").alias("c")).select("source", "parser", "file", "c.*")


def imports(parsed: DataFrame) -> DataFrame:
    return _files(parsed).select("source", "parser", F.col("f.path").alias("file"), F.explode("f.imports").alias("local", "i")).select("source", "parser", "file", "local", "i.*")


def re_exports(parsed: DataFrame) -> DataFrame:
    return _files(parsed).select("source", "parser", F.col("f.path").alias("file"), F.explode("f.re_exports").alias("r")).select("source", "parser", "file", "r.*")


def calls(parsed: DataFrame) -> DataFrame:
    return _files(parsed).select("source", "parser", F.col("f.path").alias("file"), F.explode("f.calls").alias("c")).select("source", "parser", "file", "c.*")


def response_fields(parsed: DataFrame) -> DataFrame:
    """(source, key, field, optional): the declared fields of what a route answers."""
    return provides(parsed).select("source", "key", F.explode("response.fields").alias("x")).select("source", "key", F.col("x.name").alias("field"), "x.optional")


def overlay(native: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Native rows win over overlay rows of the same keys, and earlier parsers over later ones. Both have `parser`."""
    both = native.withColumn("rank", F.lit(0)).unionByName(extra.withColumn("rank", F.lit(1)))
    cols = [c for c in native.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min(F.struct("rank", "parser", *[c for c in cols if c != "parser"])).alias("s"))
    return best.select(*keys, *[F.col(f"s.{c}").alias(c) for c in cols])


def collisions(native: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Overlay rows that lost to a native row."""
    return extra.join(native.select(*keys).distinct(), keys, "left_semi")
