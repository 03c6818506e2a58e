"""Queries of recommendations, dead code and the call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import advice, crossrules, graph, history
from codelode.plans import repository as r
from codelode.plans.bindings import relation
from codelode.session import table


def _advice(s, d):
    fixes = history.tag_counts(relation(s, d, "commit_files")).where("tag = 'FIX'").select("path", "n")
    files = relation(s, d, "commit_files")
    pairs = history.coupling(files)
    # files change together without importing each other, but for neighbours by number
    n = F.regexp_extract("a", "f([0-9]+)[.]ts$", 1).cast("int") + 1 == F.regexp_extract("b", "f([0-9]+)[.]ts$", 1).cast("int")
    imports = pairs.where(n).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return advice.recommendations(r._nodes(s, d), fixes, pairs.where("n >= 2").withColumn("n", F.col("n") * 5), imports)


def _history_of_nodes(s, d):
    """A file's changes: the orders that took the part first."""
    n = relation(s, d, "nodes").select("id", "path")
    t = table(s, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_orderkey").alias("change_count"))
    return n.join(t, "id").select("path", "change_count")


def _critical(s, d):
    e = relation(s, d, "dep_edges").where("dst = 1 + floor(src / 2)")
    n = relation(s, d, "nodes").join(_history_of_nodes(s, d), "path", "left").fillna(0, ["change_count"])
    g = graph.degrees(e).select(F.col("node").alias("id"), "fan_in")
    nodes = n.join(g, "id", "left").fillna(0, ["fan_in"]).select("id", "path", "loc", "change_count", "fan_in", (F.col("id") % 4 + 1).alias("author_count"))
    named = graph.dependents(e).join(n.select(F.col("id").alias("node"), "path"), "node").select(F.col("path").alias("node"), "dependents")
    return advice.critical_files(nodes, named)


def _masked(s, d):
    """Provides of which every third route has a placeholder at its end."""
    return relation(s, d, "provides").withColumn("key", F.when(F.col("line") % 3 == 0, F.regexp_replace("key", "/p[0-9]+$", "/{}")).otherwise(F.col("key")))


def _rule_fields(s, d):
    t = table(s, d, "rule_defs").where(F.col("rule_id").isNotNull())
    return t.select("source", F.col("pack").alias("key"), F.explode(F.split("rule_id", "[-]")).alias("field"))


def queries() -> dict:
    return {
        "sensitive_fields": lambda s, d: crossrules.sensitive_fields(_rule_fields(s, d), table(s, d, "pack_files").select(F.col("pack").alias("key"))),
        "shadowed_across": lambda s, d: crossrules.shadowed_across(_masked(s, d)),
        "silent_sources": lambda s, d: crossrules.silent_sources(
            table(s, d, "files").where(F.col("text").contains("app.get(")).select("source", "path"), table(s, d, "files").where(F.col("text").contains("HandleFunc(")).select("source")
        ),
        "recommendations": _advice,
        "recommendations_escalated": lambda s, d: advice.escalated(_advice(s, d), r._stats(s, d).where("author_count % 2 = 0").select("path")).groupBy("rule").agg(F.count("*").alias("n")),
        "dead_candidates": lambda s, d: advice.dead_candidates(graph.degrees(r._paths(s, d)), _history_of_nodes(s, d), "brand-1[0-3]/"),
        "critical_files": _critical,
        "call_transitions": lambda s, d: advice.transitions(table(s, d, "events")),
    }


def oracle_sql() -> dict[str, str]:
    gates = [
        ("bug-prone", "fixes >= 5", "fixes"),
        ("hot-churn", "loc > 30 AND churn > 10 * loc", "round(churn / loc, 3)"),
        ("fat-fanout", "fan_out >= 8 AND NOT (loc > 0 AND fan_out >= 0.5 * loc)", "fan_out"),
        ("knowledge-silo", "author_count >= 6", "author_count"),
        ("versioning-candidate", "lifecycle = 'Volatile' AND fan_in >= 3 AND fixes >= 3", "fixes"),
    ]
    price = lambda n: f"round(CAST(risk * {advice.REDUCTION[n] * advice.SEVERITY[n]} / greatest(loc + 3 * fan_in, 10) AS DOUBLE), 6)"
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, path, CAST({m} AS DOUBLE) AS measure, {price(n)} AS roi, {advice.MAX_ROWS[n]} AS most FROM n WHERE {c}" for n, c, m in gates
    )
    rows += f""" UNION ALL SELECT 'hidden-coupling', path, CAST(5 * c.n AS DOUBLE), {price('hidden-coupling')}, 15 FROM n JOIN coupling c ON c.a = path
      WHERE c.n >= 2 AND c.a < c.b AND abs(CAST(regexp_extract(a, 'f([0-9]+)[.]ts$', 1) AS INT) - CAST(regexp_extract(b, 'f([0-9]+)[.]ts$', 1) AS INT)) <> 1"""
    head = f"""{r._C}, {r._STATS}, {r._PAIRS}, {r._NODE}, fx AS (SELECT path, count(DISTINCT sha) AS fixes FROM commit_files WHERE tag = 'FIX' GROUP BY path),
      n AS (SELECT nm.*, coalesce(fixes, 0) AS fixes FROM nm LEFT JOIN fx USING (path)), a AS ({rows}),
      adv AS (SELECT rule, path, measure, roi, place FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY measure DESC, path) AS place FROM a) WHERE place <= most)"""
    masked = r.ctes("provides") + r""", p AS (SELECT DISTINCT source, CASE WHEN line % 3 = 0 THEN regexp_replace(key, '/p[0-9]+$', '/{}') ELSE key END AS key FROM provides WHERE key NOT LIKE '%*%')"""
    return {
        "sensitive_fields": r"""WITH f AS (SELECT DISTINCT source, pack AS key, unnest(string_split(rule_id, '-')) AS field FROM rule_defs WHERE rule_id IS NOT NULL)
          SELECT source, key, field, key IN (SELECT pack FROM pack_files) AS consumed FROM f
          WHERE regexp_matches(lower(replace(field, '_', '')), 'password|passwd|secret|apikey|privatekey|credential|passphrase|salt|token$') OR lower(replace(field, '_', '')) IN ('token', 'jwt', 'hash', 'pwd', 'ssn', 'otp')""",
        "shadowed_across": masked + r""" SELECT a.source, a.key, b.source AS by_source, b.key AS by_key FROM p a JOIN p b ON a.source <> b.source AND a.key NOT LIKE '%{}' AND b.key LIKE '%{}' AND regexp_replace(a.key, '/[^/]*$', '/{}') = b.key""",
        "silent_sources": "SELECT source, count(DISTINCT path) AS files FROM files WHERE contains(text, 'app.get(') AND source IS NOT NULL AND source NOT IN (SELECT source FROM files WHERE contains(text, 'HandleFunc(') AND source IS NOT NULL) GROUP BY source HAVING count(DISTINCT path) >= 3",
        "recommendations": head + " SELECT * FROM adv",
        "recommendations_escalated": head + " SELECT CASE WHEN author_count % 2 = 0 THEN 'escalated' ELSE rule END AS rule, count(*) AS n FROM adv JOIN stats USING (path) GROUP BY 1",
        "dead_candidates": r._G + """ SELECT src AS path, count(DISTINCT dst) AS fan_out FROM pe WHERE src NOT IN (SELECT dst FROM pe) AND NOT regexp_matches(src, 'brand-1[0-3]/')
          AND src NOT IN (SELECT path FROM nodes JOIN lineitem ON l_partkey = id WHERE l_linenumber = 1 GROUP BY path HAVING count(DISTINCT l_orderkey) > 3) GROUP BY src""",
        "critical_files": r._rec(r._E) + """, e AS (SELECT * FROM dep_edges WHERE dst = 1 + floor(src / 2)),
          b(node, x) AS (SELECT dst, src FROM e UNION SELECT node, src FROM b JOIN e ON x = dst),
          dd AS (SELECT node, count(DISTINCT x) FILTER (WHERE x <> node) AS blast_radius FROM b GROUP BY node),
          f AS (SELECT dst AS id, count(*) AS fan_in FROM e GROUP BY dst), h AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS c FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
          SELECT path, blast_radius, coalesce(fan_in, 0) AS fan_in, coalesce(c, 0) AS change_count, loc, nodes.id % 4 + 1 AS author_count, coalesce(c, 0) <= 2 AS silent
          FROM nodes JOIN dd ON node = nodes.id LEFT JOIN f ON f.id = nodes.id LEFT JOIN h ON h.id = nodes.id WHERE blast_radius >= 3
          ORDER BY blast_radius * ln(loc + 2.0) DESC, blast_radius DESC, path LIMIT 20""",
        "call_transitions": "SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL",
    }
