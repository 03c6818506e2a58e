"""Declarative rules compiled to Columns over source files; one pass over each text, no shuffle.

files: source, path, text. A rule is a dict; its file gates are tried once per file,
its line patterns on the lines of the files that pass, all rules in the same pass.

line rule:   id, severity, file_pattern, file_exclude, require_file, require_file_all, require_file_absent,
             line_pattern or any ([(label, regex)], the first that fits counts), exclude_pattern,
             prev_line_exclude, skip_comment_lines, marker
method rule: id, severity, file_pattern, patterns [regex], absent [regex], ordered (each pattern after the one before)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.sources.spans import function_bodies

#: comment leaders by extension (fixed values); `*` and the block opener count everywhere
LEADERS = {"#": ("py", "rb", "sh", "yml", "yaml", "toml"), "--": ("sql", "lua", "hs"), "//": ()}
#: what a generated file says of itself in a comment of its first eight lines (fixed values)
BANNERS = [
    "@generated",
    "auto-generated",
    "autogenerated",
    "automatically generated",
    "code generated by",
    "this file is generated",
    "this file was generated",
    "openapi-generator",
]
#: paths of tests (fixed value)
TEST_PATH = (
    r"(?i)((^|/)(e2e|tests?|__tests?__|spec|fixtures?|testing|cypress|playwright)/|\.tests?/|\.(test|spec)\.|[.-]spec\.|(^|/)(playwright|vitest|jest|cypress|vite)\.config\.|_test\.go$"
    r"|(^|/)test_[^/]*\.py$|_test\.py$|(?-i:Tests?\.java$)|(?-i:(^|/)Test[A-Z][^/]*\.java$)|(?-i:Tests?\.cs$))"
)
LONG_LINE, HALF_LINE = 5000, 500


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def split_lines(text: Column) -> Column:
    """Lines without their ends; what follows a last line feed is no line."""
    t = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n")
    t = F.regexp_replace(t, "\n\\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(t, "\n"))


def shape(files: DataFrame) -> DataFrame:
    """(source, path, loc, longest, minified, generated) of each file."""
    f = files.where(F.col("text").isNotNull()).withColumn("lines", split_lines(F.col("text")))
    sizes = F.transform("lines", lambda x: F.octet_length(x))
    longest = F.coalesce(F.array_max(sizes), F.lit(0))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    wide = F.aggregate(F.filter(sizes, lambda x: x >= HALF_LINE), F.lit(0), lambda a, x: a + x)
    return f.select(
        "source", "path", F.size("lines").alias("loc"), longest.alias("longest"),
        ((longest >= LONG_LINE) | ((wide > 0) & (2 * wide >= total))).alias("minified"),
        F.exists(F.slice("lines", 1, 8), lambda x: is_comment(x, extension(F.col("path"))) & _any_of(F.lower(x), BANNERS)).alias("generated"),
    )


def is_comment(line: Column, ext: Column) -> Column:
    t = F.ltrim(F.regexp_replace(line, "^\\s+", ""))
    leader = reduce(lambda acc, kv: F.when(ext.isin(*kv[1]), F.lit(kv[0])).otherwise(acc), [kv for kv in LEADERS.items() if kv[1]], F.lit("//"))
    return t.startswith(leader) | t.startswith("/*") | t.startswith("*")


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def file_gate(rule: dict) -> Column:
    """May the rule look at the file? Cheap path tests come before tests of the text."""
    path, text = F.col("path"), F.col("text")
    c = []
    if rule.get("file_pattern"):
        c.append(path.rlike(rule["file_pattern"]))
    if rule.get("file_exclude"):
        c.append(~path.rlike(rule["file_exclude"]))
    for p in [rule.get("require_file"), *rule.get("require_file_all", [])]:
        if p:
            c.append(text.rlike(p))
    c += [~text.rlike(p) for p in rule.get("require_file_absent", [])]
    return _all(c)


def line_scan(files: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id, severity, source, path, line, label, snippet): the hits of all line rules."""
    f = files.where(F.col("text").isNotNull()).withColumn("gates", F.array(*[file_gate(r) for r in rules])).where(F.exists("gates", lambda g: g))
    f = f.withColumn("ext", extension(F.col("path"))).withColumn("lines", split_lines(F.col("text")))
    f = f.select("source", "path", "ext", "gates", F.posexplode("lines").alias("i", "line"), "lines").withColumn("prev", F.coalesce(F.get("lines", F.col("i") - 1), F.lit(""))).drop("lines")
    hits = []
    for n, r in enumerate(rules):
        line, prev = F.col("line"), F.col("prev")
        c = [F.col("gates")[n]]
        if r.get("skip_comment_lines"):
            c.append(~is_comment(line, F.col("ext")))
        if r.get("exclude_pattern"):
            c.append(~line.rlike(r["exclude_pattern"]))
        if r.get("prev_line_exclude"):
            c.append(~prev.rlike(r["prev_line_exclude"]))
        if r.get("marker"):
            m = rf"(//|#|--|/\*).*\b{r['marker']}\b"
            c += [~line.rlike(m), ~prev.rlike(m)]
        choices = r.get("any") or [("", r["line_pattern"])]
        label = F.coalesce(*[F.when(line.rlike(p), F.lit(name)) for name, p in choices])
        hits.append(F.when(_all(c) & label.isNotNull(), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "info")).alias("severity"), label.alias("label"))))
    out = f.select("source", "path", (F.col("i") + 1).alias("line"), F.substring(F.trim("line"), 1, 120).alias("snippet"), F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return out.select("h.rule_id", "h.severity", "source", "path", "line", "h.label", "snippet")


def function_spans(files: DataFrame) -> DataFrame:
    """(source, path, start, end, body): each function, method and named arrow function, from its head to the end of its body."""
    return function_bodies(files)


def _places(lines: str, pattern: str) -> Column:
    """Positions of the lines that fit."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())


def _after(places: Column, at: Column) -> Column:
    return F.filter(places, lambda i: i > at)


def method_scan(files: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id, severity, source, path, start, line): functions in which every pattern hits and no absent one does."""
    f = files.where(F.col("text").isNotNull())
    gated = f.where(reduce(lambda a, b: a | b, [_all([file_gate(r), *[F.col("text").rlike(p) for p in r["patterns"]]]) for r in rules]))
    s = function_spans(gated)
    hits = []
    for r in rules:
        firsts = []
        ok = [F.col("path").rlike(r["file_pattern"])] if r.get("file_pattern") else []
        for p in r["patterns"]:
            at = _places("body", p)
            firsts.append(F.get(_after(at, firsts[-1]) if firsts and r.get("ordered") else at, F.lit(0)))
            ok.append(firsts[-1].isNotNull())
        ok += [F.size(_places("body", p)) == 0 for p in r.get("absent", [])]
        hits.append(F.when(_all(ok), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "info")).alias("severity"), (F.col("start") + firsts[-1]).alias("line"))))
    out = s.select("source", "path", "start", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return out.select("h.rule_id", "h.severity", "source", "path", "start", "h.line")


def literals(files: DataFrame) -> DataFrame:
    """(source, path, line, name, value_hash, entropy, named): string values bound to a name; the value itself isn't kept."""
    pattern = r"""(\w+)\s*[:=]\s*["']([^"'\n]{6,})["']"""
    f = files.where(F.col("text").isNotNull()).select("source", "path", F.posexplode(split_lines(F.col("text"))).alias("i", "line"))
    names, values = (F.regexp_extract_all("line", F.lit(pattern), F.lit(n)) for n in (1, 2))
    f = f.select("source", "path", "i", F.inline(F.arrays_zip(names.alias("name"), values.alias("value"))))
    return f.select(
        "source", "path", (F.col("i") + 1).alias("line"), "name", S.fnv1a_hex(F.col("value")).alias("value_hash"), S.entropy_bits(F.col("value")).alias("entropy"),
        (S.fnv1a_hex(F.col("value")) == S.fnv1a_hex(F.col("name"))).alias("named"),
    )


def literal_scan(bound: DataFrame, name: str, name_exclude: str | None, least: float) -> DataFrame:
    """Names that fit, with enough entropy, whose value isn't their own name."""
    c = F.col("name").rlike(name) & (F.col("entropy") >= least) & ~F.col("named")
    return bound.where(c & ~F.col("name").rlike(name_exclude) if name_exclude else c)


def symbol_scan(symbols: DataFrame, kind: str | None = None, name: str | None = None, exported: bool | None = None, negate: bool = False) -> DataFrame:
    """Symbols that fit all tests; negate turns the name test, and keeps all if there is none."""
    c = []
    if kind is not None:
        c.append(F.col("kind") == kind)
    if exported is not None:
        c.append(F.col("exported") == exported)
    if name is not None:
        hit = F.col("name").rlike(name)
        c.append(~hit if negate else hit)
    return symbols.where(_all(c))


def io_scan(facts: DataFrame, key: str | None = None, negate: bool = False, kind: str | None = None) -> DataFrame:
    """Provides or consumes whose key fits. A null key fails a pattern, and so passes a negated one."""
    c = [F.col("kind") == kind] if kind else []
    if key is not None:
        hit = F.coalesce(F.col("key").rlike(key), F.lit(False))
        c.append(~hit if negate else hit)
    return facts.where(_all(c))


def call_scan(calls: DataFrame, kind: str, callee: str | None = None, algorithm: str | None = None) -> DataFrame:
    c = [F.col("kind") == kind]
    for name, p in (("callee", callee), ("algorithm", algorithm)):
        if p is not None:
            c.append(F.coalesce(F.col(name).rlike(p), F.lit(False)))
    return calls.where(_all(c))


def expand_fragments(rule: dict, shared: dict[str, str]) -> dict:
    """`${name}` in a rule's patterns, replaced from the pack's fragments."""

    def sub(v):
        if isinstance(v, str):
            for k, x in shared.items():
                v = v.replace("${" + k + "}", x)
            return v
        if isinstance(v, list):
            return [sub(x) for x in v]
        return tuple(sub(x) for x in v) if isinstance(v, tuple) else v

    return {k: sub(v) for k, v in rule.items()}


def longest_prefix(facts: DataFrame, path: str, attributes: DataFrame) -> DataFrame:
    """Adds `value`: that of the longest attribute scope that holds the path. attributes: scope, value.

    A path's own ancestors are the candidates, so it is an equi-join.
    """
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys = facts.select(path).distinct().withColumn("scope", F.explode(ancestors))
    best = keys.join(attributes, "scope").groupBy(path).agg(F.max_by("value", F.struct(F.length("scope"), "value")).alias("value"))
    return facts.join(best, path, "left")
