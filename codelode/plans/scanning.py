"""Queries of the rule scanners, the findings' life and the query surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import findings as fd
from codelode.operators import link, rules
from codelode.plans.bindings import HOSTS, relation
from codelode.plans.linking import _LINK
from codelode.session import spread, table

LINE_RULES = [
    {"id": "sql-in-string", "severity": "warning", "file_pattern": r"(?i)\.(tsx?|m?js)$", "line_pattern": r"SELECT \w+ FROM", "skip_comment_lines": True},
    {"id": "magic-threshold", "severity": "info", "file_exclude": r"(?i)\.sql$", "any": [("lt", r"if .* < \d{2}"), ("gt", r"if .* > \d")], "exclude_pattern": r"return nil"},
    {"id": "raw-url", "severity": "critical", "require_file": r"https://", "require_file_absent": [r"istanbul"], "line_pattern": r"https?://\w+\.example", "prev_line_exclude": r"^\s*//", "marker": "raw-url-ok"},
]
METHOD_RULES = [
    {"id": "query-then-cache", "severity": "warning", "file_pattern": r"(?i)\.(tsx?|m?js)$", "patterns": [r"await db\.", r"cache\.set"], "ordered": True},
    {"id": "query-unguarded", "severity": "info", "patterns": [r"SELECT \w+"], "absent": [r"\bif\b"]},
]
EVENTS = ["click", "view", "purchase", "refund"]
GLOBS = ["core/**", "**/*.{sql,py}"]


def _files(s, d):
    return spread(table(s, d, "files"))


def _now(s, d):
    return fd.normalised(fd.current(table(s, d, "findings")), {})


def _halves(s, d):
    f = fd.current(table(s, d, "findings")).select("source", "rule_id", "file", "line", "found_at")
    cut = F.lit("2025-01-01").cast("timestamp")
    return f.where(F.col("found_at") < cut), f.where(F.col("found_at") >= cut)


def _classified(s, d):
    return link.classify(relation(s, d, "consumes"), relation(s, d, "provides"), HOSTS)


def queries() -> dict:
    identity = ["rule_id", "source"]
    return {
        "file_shape": lambda s, d: rules.shape(_files(s, d)).groupBy("minified", "generated").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.max("longest").alias("longest")),
        "coverage_census": lambda s, d: _files(s, d).groupBy(rules.extension(F.col("path")).alias("ext")).agg(
            F.count("*").alias("files"), F.count_if(F.col("text").isNull()).alias("unread"), F.count_if(rules.is_test(F.col("path"))).alias("tests")
        ),
        "line_scan": lambda s, d: rules.line_scan(_files(s, d), LINE_RULES).select("rule_id", "severity", "source", "path", "line", "label"),
        "method_scan": lambda s, d: rules.method_scan(_files(s, d), METHOD_RULES),
        "literal_scan": lambda s, d: rules.literal_scan(rules.literals(_files(s, d)), r"(?i)key|token|secret|pattern|url", r"(?i)test", 80.0).select("source", "path", "line", "name", "entropy", "value_hash"),
        "io_scan": lambda s, d: rules.io_scan(relation(s, d, "consumes"), r"^GET /api", True, "http").select("id", "key"),
        "attribute_lookup": lambda s, d: rules.longest_prefix(
            relation(s, d, "nodes").select("id", "path"), "path", s.createDataFrame([("pkg1", "a"), ("pkg1/m1", "b"), ("pkg2", "c"), ("pkg1/m1/brand-12", "d")], "scope string, value string")
        ),
        "findings_current": lambda s, d: _now(s, d).select("finding_id", "source", "rule_id", "severity", "severity_rank", "file", "line", "ingests"),
        "findings_census": lambda s, d: fd.census(_now(s, d)),
        "findings_top": lambda s, d: fd.top(_now(s, d), "warning", 200).select("finding_id", "severity", "file", "line", "rule_id"),
        "findings_suppressed": lambda s, d: fd.suppressed(_now(s, d), GLOBS).groupBy("severity").agg(F.count("*").alias("n")),
        "findings_redacted": lambda s, d: fd.redacted(_now(s, d), ["**/*.sql"]).select("finding_id", F.size("evidence_paths").alias("n_evidence")),
        "manifest_diff": lambda s, d: fd.compare(*_halves(s, d), identity),
        "blind_sources": lambda s, d: fd.blind_sources(*_halves(s, d)),
        "endpoint_query": lambda s, d: fd.bucket_query(_classified(s, d), "brand-23/p1"),
        "nearest_keys": lambda s, d: fd.nearest_keys(relation(s, d, "provides"), "p1999"),
        "enum_drift": lambda s, d: fd.enum_drift(table(s, d, "events"), "event_type", EVENTS),
        "unreferenced": lambda s, d: fd.unreferenced(table(s, d, "rule_defs").select(F.explode(F.split("rule_id", "-")).alias("name")), _files(s, d), "text"),
    }


_LINES = """WITH f AS (SELECT file_id, source, path, text, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext,
    CASE WHEN length(text) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(replace(regexp_replace(text, '^﻿', ''), chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) END AS ls FROM files WHERE text IS NOT NULL),
l AS (SELECT file_id, source, path, text, ext, i AS line, ls[i] AS s, CASE WHEN i > 1 THEN ls[i - 1] ELSE '' END AS prev FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM f))"""
_COMMENT = "(starts_with(regexp_replace(s, '^\\s+', ''), CASE WHEN ext IN ('py', 'rb', 'sh', 'yml', 'yaml', 'toml') THEN '#' WHEN ext IN ('sql', 'lua', 'hs') THEN '--' ELSE '//' END) OR regexp_matches(s, '^\\s*(/\\*|\\*)'))"


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _line_sql(r: dict) -> str:
    c = []
    if r.get("file_pattern"):
        c.append(f"regexp_matches(path, {_q(r['file_pattern'])})")
    if r.get("file_exclude"):
        c.append(f"NOT regexp_matches(path, {_q(r['file_exclude'])})")
    if r.get("require_file"):
        c.append(f"regexp_matches(text, {_q(r['require_file'])})")
    c += [f"NOT regexp_matches(text, {_q(p)})" for p in r.get("require_file_absent", [])]
    if r.get("skip_comment_lines"):
        c.append(f"NOT {_COMMENT}")
    if r.get("exclude_pattern"):
        c.append(f"NOT regexp_matches(s, {_q(r['exclude_pattern'])})")
    if r.get("prev_line_exclude"):
        c.append(f"NOT regexp_matches(prev, {_q(r['prev_line_exclude'])})")
    if r.get("marker"):
        m = _q(rf"(//|#|--|/\*).*\b{r['marker']}\b")
        c += [f"NOT regexp_matches(s, {m})", f"NOT regexp_matches(prev, {m})"]
    choices = r.get("any") or [("", r["line_pattern"])]
    label = "CASE " + " ".join(f"WHEN regexp_matches(s, {_q(p)}) THEN {_q(n)}" for n, p in choices) + " END"
    return f"SELECT {_q(r['id'])} AS rule_id, {_q(r.get('severity', 'info'))} AS severity, source, path, line, {label} AS label FROM l WHERE {' AND '.join([*c, f'{label} IS NOT NULL'])}"


_NOW = """WITH now AS (
  SELECT finding_id, count(*) AS ingests, any_value(source) AS source, any_value(rule_id) AS rule_id, lower(trim(any_value(severity))) AS severity, any_value(file) AS file,
    any_value(CASE WHEN line >= 1 THEN line END) AS line, any_value(evidence_paths) AS evidence_paths, any_value(found_at) AS found_at
  FROM findings WHERE finding_id IS NOT NULL GROUP BY finding_id),
r AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS severity_rank FROM now)"""
_CUT = "TIMESTAMP '2025-01-01 00:00:00'"


def oracle_sql() -> dict[str, str]:
    from codelode.plans.bindings import ctes

    return {
        "file_shape": _LINES
        + """, z AS (SELECT path, len(ls) AS loc, coalesce(list_max([strlen(x) FOR x IN ls]), 0) AS longest, coalesce(list_sum([strlen(x) FOR x IN ls]), 0) AS total,
            coalesce(list_sum([strlen(x) FOR x IN ls IF strlen(x) >= 500]), 0) AS wide, len([x FOR x IN ls[1:8] IF regexp_matches(lower(x), '@generated|auto-generated|autogenerated|automatically generated|code generated by|this file is generated|this file was generated|openapi-generator')
              AND regexp_matches(x, CASE WHEN ext = 'py' THEN '^\\s*(#|/[*]|[*])' WHEN ext = 'sql' THEN '^\\s*(--|/[*]|[*])' ELSE '^\\s*(//|/[*]|[*])' END)]) > 0 AS generated FROM f)
          SELECT longest >= 5000 OR (wide > 0 AND 2 * wide >= total) AS minified, generated, count(*) AS files, sum(loc) AS loc, max(z.longest) AS longest FROM z GROUP BY 1, 2""",
        "coverage_census": r"""SELECT lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS files, count(*) FILTER (WHERE text IS NULL) AS unread,
          count(*) FILTER (WHERE regexp_matches(path, '""" + rules.TEST_PATH + r"""')) AS tests FROM files GROUP BY 1""",
        "line_scan": _LINES + " " + " UNION ALL ".join(_line_sql(r) for r in LINE_RULES),
        "io_scan": ctes("consumes") + " SELECT id, key FROM consumes WHERE key IS NULL OR NOT regexp_matches(key, '^GET /api')",
        "attribute_lookup": ctes("nodes") + """ SELECT id, path, CASE WHEN starts_with(path, 'pkg1/m1/brand-12/') THEN 'd' WHEN starts_with(path, 'pkg1/m1/') THEN 'b' WHEN starts_with(path, 'pkg1/') THEN 'a'
          WHEN starts_with(path, 'pkg2/') THEN 'c' END AS value FROM nodes""",
        "findings_current": _NOW + " SELECT finding_id, source, rule_id, severity, severity_rank, file, line, ingests FROM r",
        "findings_census": _NOW + " SELECT severity, rule_id, count(*) AS n, grouping_id(severity, rule_id) AS level FROM r GROUP BY ROLLUP (severity, rule_id)",
        "findings_top": _NOW + " SELECT finding_id, severity, file, line, rule_id FROM r WHERE severity_rank <= 1 ORDER BY severity_rank, file NULLS LAST, line NULLS LAST, rule_id NULLS LAST, finding_id LIMIT 200",
        "findings_suppressed": _NOW + r" SELECT severity, count(*) AS n FROM r WHERE NOT coalesce(regexp_matches(file, '^core/|^(.*/)?[^/]*\.(sql|py)$'), false) GROUP BY severity",
        "findings_redacted": _NOW + " SELECT finding_id, len([x FOR x IN evidence_paths IF NOT regexp_matches(x, '\\.sql$')]) AS n_evidence FROM r",
        "manifest_diff": _NOW
        + f""", b AS (SELECT DISTINCT rule_id, source FROM r WHERE found_at < {_CUT}), a AS (SELECT DISTINCT rule_id, source FROM r WHERE found_at >= {_CUT})
          SELECT *, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
        "blind_sources": _NOW + f" SELECT DISTINCT source FROM r WHERE found_at < {_CUT} AND source IS NOT NULL AND source NOT IN (SELECT source FROM r WHERE found_at >= {_CUT} AND source IS NOT NULL)",
        "endpoint_query": _LINK
        + """, h AS (SELECT count(DISTINCT bucket) AS n, min(bucket) AS one, count(*) AS matches FROM c WHERE contains(lower(join_key), 'brand-23/p1'))
          SELECT 'brand-23/p1' AS pattern, CASE n WHEN 0 THEN 'not-found' WHEN 1 THEN one ELSE 'mixed' END AS verdict, matches FROM h""",
        "nearest_keys": ctes("provides")
        + """, k AS (SELECT DISTINCT key FROM provides), z AS (SELECT key, least(levenshtein(key, 'p1999'), list_min([levenshtein(x, 'p1999') FOR x IN regexp_split_to_array(key, '[ /]+')])) AS distance FROM k)
          SELECT * FROM z WHERE distance <= 2 ORDER BY distance, key LIMIT 10""",
        "enum_drift": "WITH s AS (SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1), d AS (SELECT unnest("
        + str(EVENTS)
        + ") AS value) SELECT coalesce(s.value, d.value) AS value, coalesce(n, 0) AS n, d.value IS NOT NULL AS declared FROM s FULL JOIN d ON s.value = d.value WHERE n IS NULL OR d.value IS NULL",
        "unreferenced": r"""WITH n AS (SELECT DISTINCT unnest(string_split(rule_id, '-')) AS name FROM rule_defs), t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\w+')) AS name FROM files)
          SELECT name FROM n WHERE length(name) >= 3 AND name NOT IN (SELECT name FROM t)""",
    }
