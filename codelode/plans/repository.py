"""Queries of history, graph and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import graph, history, scores
from codelode.plans.bindings import ctes, relation
from codelode.session import cut

NOW = "TIMESTAMP '1998-08-01 00:00:00'"


def _files(s, d):
    return relation(s, d, "commit_files")


def _stats(s, d):
    return history.path_stats(_files(s, d), F.expr(NOW))


def _paths(s, d):
    """Import edges between paths."""
    n = relation(s, d, "nodes").select("id", "path")
    e = relation(s, d, "dep_edges")
    return e.join(n.select(F.col("id").alias("src"), F.col("path").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _nodes(s, d):
    st = _stats(s, d)
    loc = st.select("path", (F.length("path") * 10).cast("bigint").alias("loc"))
    half = history.cochange_edges(history.coupling(_files(s, d)))
    deg = graph.degrees(half.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "path")
    return history.node_metrics(st, loc, deg, F.expr(NOW))


def _scores(s, d):
    n_cycles = graph.cycles(graph.scc(relation(s, d, "dep_edges"))).count()
    # each metric reads the edges and files again: they are made once, and the driver's plan stays small
    return scores.all_scores(cut(_paths(s, d)), cut(relation(s, d, "nodes")), n_cycles, cut(_stats(s, d)))


def queries() -> dict:
    return {
        "git_path_stats": lambda s, d: _stats(s, d),
        "git_tag_counts": lambda s, d: history.tag_counts(_files(s, d)),
        "git_author_commits": lambda s, d: history.author_commits(_files(s, d)),
        "git_window": lambda s, d: history.history_window(_files(s, d)),
        "coupling": lambda s, d: history.coupling(_files(s, d)),
        "cochange_edges": lambda s, d: history.cochange_edges(history.coupling(_files(s, d))),
        "layer_cochurn": lambda s, d: history.layer_cochurn(_files(s, d)),
        "node_metrics": _nodes,
        "folder_rollup": lambda s, d: history.folder_rollup(_nodes(s, d), 2),
        "bus_factor": lambda s, d: history.bus_factor(_stats(s, d)),
        "fix_ratio": lambda s, d: history.fix_ratio(_files(s, d)),
        "knowledge_silo": lambda s, d: history.knowledge_silo(_stats(s, d)),
        "degrees": lambda s, d: graph.degrees(relation(s, d, "dep_edges")),
        "scc": lambda s, d: graph.scc(relation(s, d, "dep_edges")),
        "cycles": lambda s, d: graph.cycles(graph.scc(relation(s, d, "dep_edges"))),
        "reach": lambda s, d: graph.reach(relation(s, d, "dep_edges"), relation(s, d, "nodes").select(F.min("id").alias("node"))),
        "unreachable": lambda s, d: graph.unreachable(relation(s, d, "dep_edges"), relation(s, d, "nodes").select(F.max("id").alias("node"))),
        "dependents": lambda s, d: graph.dependents(relation(s, d, "dep_edges"), 3),
        "diamonds": lambda s, d: graph.diamonds(relation(s, d, "dep_edges")),
        "folder_edges": lambda s, d: graph.folder_edges(_paths(s, d), 1),
        "seams": lambda s, d: graph.seams(_paths(s, d), relation(s, d, "nodes"), _paths(s, d).select(F.col("src").alias("a"), F.col("dst").alias("b")), 2),
        "scores": _scores,
        "health": lambda s, d: scores.health(_scores(s, d)),
    }


_C = ctes("commit_files")
_STATS = f"""stats AS (
  SELECT path, count(*) AS change_count, sum(churn) AS churn, max(ts) AS last_modified, count(DISTINCT author) AS author_count,
    count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 30 DAYS) AS recent_change_count, coalesce(sum(churn) FILTER (WHERE ts >= {NOW} - INTERVAL 30 DAYS), 0) AS recent_churn
  FROM (SELECT sha, path, max(ts) AS ts, max(author) AS author, sum(added + deleted) AS churn FROM commit_files GROUP BY ALL) GROUP BY path)"""
_PAIRS = """f AS (SELECT DISTINCT sha, path FROM commit_files), g AS (SELECT sha FROM f GROUP BY sha HAVING count(*) BETWEEN 2 AND 25),
pairs AS (SELECT x.path AS a, y.path AS b, count(*) AS n FROM f x JOIN f y ON x.sha = y.sha AND x.path <> y.path JOIN g ON g.sha = x.sha GROUP BY 1, 2),
coupling AS (SELECT * FROM (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM pairs) WHERE place <= 10),
cc AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(n) AS n FROM coupling GROUP BY 1, 2)"""
_FOLDER = "CASE WHEN {p} LIKE '%/%' THEN array_to_string(string_split({p}, '/')[1:least(len(string_split({p}, '/')) - 1, {n})], '/') ELSE '.' END"
_NODE = f"""deg AS (SELECT path, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT a AS path, 0 AS i, 1 AS o FROM cc UNION ALL SELECT b, 1, 0 FROM cc) GROUP BY path),
med AS (SELECT median(churn) AS m FROM stats WHERE churn > 0),
nm AS (SELECT path, change_count, churn, CAST(length(path) * 10 AS BIGINT) AS loc, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, author_count,
  round(0.4 * change_count + 0.2 * churn + 0.4 * (coalesce(fan_in, 0) + coalesce(fan_out, 0)), 4) AS risk, CASE WHEN change_count >= 2 THEN change_count * length(path) * 10 ELSE 0 END AS hotspot,
  CASE WHEN churn > m AND last_modified >= {NOW} - INTERVAL 30 DAYS THEN 'Volatile' WHEN churn > m THEN 'Settled' WHEN last_modified >= {NOW} - INTERVAL 30 DAYS THEN 'Fresh' ELSE 'Stable' END AS lifecycle
  FROM stats LEFT JOIN deg USING (path), med)"""
_E = ctes("dep_edges", "nodes")
_G = _E + f""", pe AS (SELECT a.path AS src, b.path AS dst FROM dep_edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id),
mo AS (SELECT {_FOLDER.format(p='src', n=2)} AS a, {_FOLDER.format(p='dst', n=2)} AS b, src, dst FROM pe)"""
_SCORES = _G + f""", fm AS (SELECT {_FOLDER.format(p='path', n=2)} AS module, count(*) AS files FROM nodes GROUP BY 1),
md AS (SELECT module, count(*) FILTER (WHERE k = 'i') AS internal, count(*) FILTER (WHERE k = 'o') AS out_edges, count(*) FILTER (WHERE k = 'n') AS in_edges
  FROM (SELECT a AS module, CASE WHEN a = b THEN 'i' ELSE 'o' END AS k FROM mo UNION ALL SELECT b, 'n' FROM mo WHERE a <> b) GROUP BY module),
inst AS (SELECT module, CASE WHEN out_edges + in_edges = 0 THEN 0.0 ELSE out_edges / (out_edges + in_edges) END AS i FROM md),
co AS (SELECT count(*) AS p, sum(CASE WHEN coalesce(internal, 0) + coalesce(out_edges, 0) = 0 THEN 1.0 ELSE internal / (internal + out_edges) END * files) AS w, sum(files) AS f FROM fm LEFT JOIN md USING (module)),
fo AS (SELECT count(*) AS p, avg(n) AS m FROM (SELECT src, count(DISTINCT dst) AS n FROM pe GROUP BY src)),
mm AS (SELECT sum(internal) + sum(out_edges) AS m FROM md),
qq AS (SELECT count(*) AS p, sum(internal / m - ((2 * internal + out_edges + in_edges) / (2 * m)) ** 2) AS q FROM md, mm),
r AS (
  SELECT 'sdp' AS metric, count(*) AS p, count(*) FILTER (WHERE x.i < y.i) AS h FROM mo JOIN inst x ON a = x.module JOIN inst y ON b = y.module WHERE a <> b
  UNION ALL SELECT 'hierarchy', count(*), count(*) FILTER (WHERE starts_with(regexp_replace(src, '/[^/]*$', ''), regexp_replace(dst, '/[^/]*$', '') || '/')) FROM mo WHERE a = b
  UNION ALL SELECT 'sibling_cross', count(*), count(*) FILTER (WHERE len(string_split(src, '/')) > 3 AND len(string_split(dst, '/')) > 3 AND string_split(src, '/')[3] <> string_split(dst, '/')[3] AND string_split(dst, '/')[3] NOT IN ('shared', 'common', 'utils')) FROM mo WHERE a = b
  UNION ALL SELECT 'public_api', count(*), count(*) FILTER (WHERE NOT (len(string_split(dst, '/')) = 3 OR regexp_matches(dst, '^[^/]+/[^/]+/src/[^/]+$'))) FROM mo WHERE a <> b
  UNION ALL SELECT 'file_size', count(*), count(*) FILTER (WHERE loc > 200) FROM nodes),
scores AS (
  SELECT metric, p AS population, CAST(h AS DOUBLE) AS hits, CASE WHEN p = 0 THEN 100.0 ELSE round(100.0 * (1 - h / p), 1) END AS score FROM r
  UNION ALL SELECT 'god_file', count(*), CAST(count(*) FILTER (WHERE loc > 300) AS DOUBLE), greatest(0.0, round(100 - 200.0 * count(*) FILTER (WHERE loc > 300) / count(*), 1)) FROM nodes
  UNION ALL SELECT 'cohesion', p, round(w, 3), round(100 * w / f, 1) FROM co
  UNION ALL SELECT 'coupling', p, round(m, 3), round(greatest(0.0, 100 - 10 * greatest(m - 5, 0.0)), 1) FROM fo
  UNION ALL SELECT 'modularity', p, round(q, 4), round(greatest(0.0, least(100.0, q / 0.3 * 100)), 1) FROM qq)"""
_REACH = ", rc(start, node) AS (SELECT src, dst FROM e UNION SELECT rc.start, e.dst FROM rc JOIN e ON rc.node = e.src)"


def _rec(body: str) -> str:
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


def oracle_sql() -> dict[str, str]:
    comp = _rec(_E) + ", e AS (SELECT DISTINCT src, dst FROM dep_edges)" + _REACH
    scc = comp + ", sc AS (SELECT x.start AS node, min(x.node) AS component FROM rc x JOIN rc y ON x.start = y.node AND x.node = y.start GROUP BY x.start)"
    return {
        "git_path_stats": f"{_C}, {_STATS} SELECT * FROM stats",
        "git_tag_counts": f"{_C} SELECT path, tag, count(DISTINCT sha) AS n FROM commit_files WHERE tag IS NOT NULL GROUP BY path, tag",
        "git_author_commits": f"{_C} SELECT path, author, count(DISTINCT sha) AS n FROM commit_files GROUP BY path, author",
        "git_window": f"{_C} SELECT min(ts) AS first, max(ts) AS last, count(DISTINCT sha) AS commits FROM commit_files",
        "coupling": f"{_C}, {_PAIRS} SELECT * FROM coupling",
        "cochange_edges": f"{_C}, {_PAIRS} SELECT * FROM cc",
        "layer_cochurn": f"""{_C}, {_PAIRS}, p AS (SELECT *, {_FOLDER.format(p='a', n=2)} AS la, {_FOLDER.format(p='b', n=2)} AS lb FROM pairs WHERE a < b AND n >= 2),
          q AS (SELECT *, least(la, lb) AS x, greatest(la, lb) AS y FROM p WHERE la <> lb), r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, a, b) AS place FROM q)
          SELECT x, y, sum(n) AS co_changes, count(*) AS pairs, string_agg(a || '+' || b, ',' ORDER BY place) FILTER (WHERE place <= 5) AS examples FROM r GROUP BY x, y ORDER BY co_changes DESC, x, y LIMIT 20""",
        "node_metrics": f"{_C}, {_STATS}, {_PAIRS}, {_NODE} SELECT * FROM nm",
        "folder_rollup": f"""{_C}, {_STATS}, {_PAIRS}, {_NODE} SELECT {_FOLDER.format(p='path', n=2)} AS folder, count(*) AS files, round(sum(risk), 3) AS risk_sum, round(avg(risk), 3) AS risk_avg, max(risk) AS risk_max,
          sum(change_count) AS changes, sum(churn) AS churn, sum(loc) AS loc FROM nm GROUP BY 1""",
        "bus_factor": f"{_C}, {_STATS} SELECT 'bus_factor' AS metric, count(*) AS population, count(*) FILTER (WHERE author_count = 1) AS hits FROM stats WHERE change_count >= 10",
        "fix_ratio": f"""{_C}, t AS (SELECT DISTINCT sha, path, tag FROM commit_files WHERE tag IS NOT NULL)
          SELECT 'fix_ratio' AS metric, count(*) AS population, count(*) FILTER (WHERE tag = 'FIX') AS hits FROM t""",
        "knowledge_silo": f"{_C}, {_STATS} SELECT path, author_count, change_count FROM stats WHERE author_count >= 6",
        "degrees": _E + """ SELECT node, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM dep_edges UNION ALL SELECT dst, 1, 0 FROM dep_edges) GROUP BY node""",
        "scc": scc + " SELECT node, component FROM sc",
        "cycles": scc + " SELECT component, count(*) AS size, min(node) AS first FROM sc GROUP BY component",
        "reach": _rec(_E) + """, b(node, depth) AS (SELECT min(id), 0 FROM nodes UNION SELECT dst, depth + 1 FROM b JOIN dep_edges ON node = src WHERE depth < 60)
          SELECT (SELECT min(id) FROM nodes) AS start, node, min(depth) AS depth FROM b GROUP BY node""",
        "unreachable": _rec(_E) + """, s AS (SELECT max(id) AS node FROM nodes UNION SELECT src FROM dep_edges WHERE src NOT IN (SELECT dst FROM dep_edges)),
          b(node) AS (SELECT node FROM s UNION SELECT dst FROM b JOIN dep_edges ON node = src)
          SELECT dst AS node, count(*) AS fan_in FROM dep_edges WHERE dst NOT IN (SELECT node FROM b) GROUP BY dst""",
        "dependents": _E + """, r AS (SELECT dst AS node, src AS x FROM dep_edges UNION SELECT a.dst, b.src FROM dep_edges a JOIN dep_edges b ON a.src = b.dst
            UNION SELECT a.dst, c.src FROM dep_edges a JOIN dep_edges b ON a.src = b.dst JOIN dep_edges c ON b.src = c.dst)
          SELECT node, count(*) AS dependents FROM r WHERE node <> x GROUP BY node""",
        "diamonds": _E + """, e AS (SELECT * FROM dep_edges WHERE src <> dst), t AS (SELECT a.src AS root, b.dst AS leaf, count(DISTINCT a.dst) AS mids FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY ALL)
          SELECT * FROM t WHERE mids >= 2 AND NOT EXISTS (SELECT 1 FROM e WHERE src = root AND dst = leaf)""",
        "folder_edges": _G + f", z AS (SELECT {_FOLDER.format(p='src', n=1)} AS from_folder, {_FOLDER.format(p='dst', n=1)} AS to_folder FROM pe) SELECT from_folder, to_folder, count(*) AS n FROM z WHERE from_folder <> to_folder GROUP BY ALL",
        "seams": _G + f""", fm AS (SELECT {_FOLDER.format(p='path', n=2)} AS folder, count(*) AS files FROM nodes GROUP BY 1 HAVING count(*) >= 3),
          k AS (SELECT folder, count(*) FILTER (WHERE t = 'i') AS internal, count(*) FILTER (WHERE t = 'o') AS out_edges, count(*) FILTER (WHERE t = 'n') AS in_edges
            FROM (SELECT a AS folder, CASE WHEN a = b THEN 'i' ELSE 'o' END AS t FROM mo UNION ALL SELECT b, 'n' FROM mo WHERE a <> b) GROUP BY folder),
          z AS (SELECT folder, files, coalesce(internal, 0) AS internal, coalesce(out_edges, 0) AS out_edges, coalesce(in_edges, 0) AS in_edges, coalesce(out_edges, 0) + coalesce(in_edges, 0) AS temporal FROM fm LEFT JOIN k USING (folder))
          SELECT *, round(internal / (in_edges + out_edges + temporal + 1), 4) AS score FROM z ORDER BY score DESC, folder LIMIT 15""",
        "scores": _SCORES + " SELECT * FROM scores",
        "health": _SCORES
        + ", w(metric, w) AS (VALUES "
        + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in scores.WEIGHTS.items())
        + ") SELECT round(sum(round(w * (100 - score) / 10, 2)) * 18.6 / sum(w), 1) AS pain, round(sum(w), 1) AS measured_weight, CAST(18.6 AS DOUBLE) AS total_weight FROM scores JOIN w USING (metric) WHERE population > 0",
    }
