"""Scalar functions of interface keys, paths, secrets and commit subjects, as Columns."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- interface keys ("VERB /path")


def normalize_http_path(path: Column) -> Column:
    """One leading slash, no doubled or trailing ones; `{x}` and `:x` (after `/`, `.`, `-`) become `{}`."""
    p = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(path, F.lit(""))), "/+", "/")
    p = F.regexp_replace(p, r"\{[^}]+\}", "{}")
    p = F.regexp_replace(p, r"([/.-]):[A-Za-z_][A-Za-z0-9_]*", "$1{}")
    return F.regexp_replace(p, r"(.)/+$", "$1")


def http_key(method: Column, path: Column) -> Column:
    return F.concat(F.upper(method), F.lit(" "), normalize_http_path(path))


def http_consume_key(method: Column, url: Column) -> Column:
    """As http_key, without query and fragment."""
    return http_key(method, F.regexp_replace(url, "[?#].*$", ""))


def verb(key: Column) -> Column:
    return F.substring_index(key, " ", 1)


def path_of(key: Column) -> Column:
    """What follows the first blank; null if there is none."""
    return F.when(F.instr(key, " ") > 0, F.substr(key, F.instr(key, " ") + 1))


def segments(key: Column) -> Column:
    return F.filter(F.split(path_of(key), "/"), lambda s: s != "")


def carries_identity(key: Column) -> Column:
    """Is there a literal segment (or no segment at all)? Keys that aren't `VERB /path` always carry identity."""
    s = segments(key)
    return F.coalesce((F.size(s) == 0) | F.exists(s, lambda x: x != "{}"), F.lit(True))


def is_wildcard(key: Column) -> Column:
    return F.coalesce(path_of(key).contains("*"), F.lit(False))


def lower_first(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))


def ant_to_regex(pattern: str) -> str:
    """Java regex of an ANT path pattern: `**` any segments; a segment with `*`, `?` or `{x}` is any one segment."""
    out = "^/*"
    first = True
    segs = pattern.lstrip("/").split("/")
    for i, s in enumerate(segs):
        if s == "**":
            if i == len(segs) - 1:
                return out + (".*$" if first else "(?:/.*)?$")
            out += "(?:[^/]*/)*" if first else "(?:/[^/]*)*"
            continue
        any_one = s == "*" or "*" in s or "?" in s or (s.startswith("{") and s.endswith("}"))
        joined = first and not (i > 0 and segs[i - 1] == "**")
        out += ("" if joined or (first and i > 0) else "/") + ("[^/]*" if any_one else re.escape(s))
        first = False
    return out + "$"


# --- external URLs in keys

_URL = r"^(\S+) ([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def url_scheme(key: Column) -> Column:
    return F.lower(F.regexp_extract(key, _URL, 2))


def url_authority(key: Column) -> Column:
    return F.regexp_extract(key, _URL, 3)


def url_host(key: Column) -> Column:
    return F.lower(F.substring_index(url_authority(key), ":", 1))


def url_path(key: Column) -> Column:
    p = F.regexp_extract(key, _URL, 4)
    return F.when(p == "", "/").otherwise(p)


def registrable_domain(host: Column) -> Column:
    """The last two labels; addresses as they are."""
    return F.when(is_ip(host), host).otherwise(F.substring_index(host, ".", -2))


def is_ip(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


_VERSION = r"^v\d+(\.\d+)*$"


def is_version(segment: Column) -> Column:
    return F.lower(segment).rlike(_VERSION)


# --- secrets: hash and entropy are all that is kept of a value


@F.pandas_udf(T.StringType())
def fnv1a_hex(values: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes, as 16 hex digits."""

    def one(v):
        if v is None:
            return None
        h = 0xCBF29CE484222325
        for b in v.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return values.map(one)


@F.pandas_udf(T.DoubleType())
def entropy_bits(values: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes times their number, on a grid of 1/8."""

    def one(v):
        if v is None:
            return None
        c = np.bincount(np.frombuffer(v.encode(), np.uint8)).astype(float)
        c = c[c > 0]
        total = float(-(c * np.log2(c / c.sum())).sum()) if len(c) else 0.0
        return np.floor(total * 8 + 0.5) / 8 + 0.0

    return values.map(one)


@F.pandas_udf(T.StringType())
def mask_literals(lines: pd.Series) -> pd.Series:
    """Blanks what stands between quotes, keeping length; an unterminated quote stops the masking."""

    def one(line):
        if line is None or not any(q in line for q in "\"'`"):
            return line
        out, i = list(line), 0
        while i < len(line):
            q = line[i]
            if q in "\"'`":
                j = i + 1
                while j < len(line) and line[j] != q:
                    j += 2 if line[j] == "\\" else 1
                if j >= len(line):
                    break
                out[i + 1 : j] = " " * (j - i - 1)
                i = j
            i += 1
        return "".join(out)

    return lines.map(one)


# --- paths and globs


def glob_to_regex(glob: str) -> str:
    """`**` crosses folders, `*` and `?` don't, `{a,b}` is a choice."""
    out, i, depth = "^", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return out + "$"


def path_under(path: Column, prefix: Column) -> Column:
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def folder_of(path: Column, depth: int) -> Column:
    """The first `depth` folders; never the file's own name."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth))), "/")
    ).otherwise(".")


# --- commit subjects

#: classifiers of a subject without a bracketed tag, first match wins (fixed values)
SUBJECT_TAGS = [
    (r"^\s*revert(?:ed|s|ing)?\b", "REVERT"),
    (r"^\s*(?:fix(?:ed|es|ing)?|bug\s?fix(?:ed|es)?|hotfix)\b", "FIX"),
    (r"^\s*(?:feat(?:ure)?|add(?:ed|s)?|new|implement(?:ed|s|ation)?|introduce[ds]?)\b", "FEAT"),
    (r"^\s*(?:refactor(?:ed|ing)?|cleanup|clean[\s-]?up|rework(?:ed)?|simplif(?:y|ied|ies))\b", "REFACTOR"),
    (r"^\s*(?:perf(?:ormance)?|optimi[sz])", "PERF"),
    (r"^\s*(?:docs?|documentation|readme)\b", "DOCS"),
    (r"^\s*(?:tests?|testing|spec)\b", "TEST"),
    (r"^\s*(?:chore|build|ci|bump|release|version|deps?)\b", "CHORE"),
    (r"^\s*(?:style|lint|format|prettier)\b", "STYLE"),
]


def commit_tags(subject: Column) -> Column:
    """Bracketed tags, upper case; else the first classifier that fits the subject without its scope."""
    bracketed = F.transform(F.regexp_extract_all(subject, F.lit(r"\[([A-Za-z]+)\]"), F.lit(1)), F.upper)
    bare = F.lower(F.regexp_replace(F.trim(subject), r"^(\w+)\([^)]*\)", "$1"))
    rule = F.coalesce(*[F.when(bare.rlike(p), F.lit(t)) for p, t in SUBJECT_TAGS])
    return F.when(F.size(bracketed) > 0, bracketed).when(rule.isNotNull(), F.array(rule)).otherwise(F.array().cast("array<string>"))


# --- findings

SEVERITIES = ("critical", "warning", "info")


def severity_rank(severity: Column) -> Column:
    """0 is the gravest; spellings differ in case and blanks only. Anything else ranks behind all."""
    s = F.lower(F.trim(severity))
    return F.coalesce(*[F.when(s == x, F.lit(i)) for i, x in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))
