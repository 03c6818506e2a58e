"""Queries over the facts of the source files themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import graph, link
from codelode.session import cut, spread, table
from codelode.sources import facts as X


#: the tree of a source: each file lies flat under the last word of its name, in which the imports of the texts lead somewhere
FLAT = """SELECT source, min(path) AS own, lower(regexp_extract(path, '([A-Z][a-z]+|[a-z]+)[.][A-Za-z]+$', 1)) || '.' || lower(regexp_extract(path, '[.]([A-Za-z]+)$', 1)) AS path
FROM files WHERE path IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND length(text) > 0 GROUP BY 1, 3"""


def _facts(s, d):
    return X.file_facts(spread(table(s, d, "files").select("source", "path", "text")))


def _flat(s, d):
    files = table(s, d, "files")
    named = s.sql(FLAT.replace("FROM files", "FROM {files}"), files=files)
    texts = files.groupBy("source", F.col("path").alias("own")).agg(F.min("text").alias("text"))
    return named.join(texts, ["source", "own"]).select("source", "path", "text")


def _of(fact, *columns):
    return lambda s, d: _facts(s, d).where(F.col("fact") == fact).select("source", "path", "line", *columns).distinct()


def _both(s, d):
    files = cut(_flat(s, d))
    facts = cut(X.file_facts(spread(files)))  # read by several branches
    return facts, X.import_edges(facts, files)


def _graph(s, d):
    facts, edges = _both(s, d)
    return facts, edges, X.symbol_graph(facts, edges)


def _cycles(s, d):
    e = X.dependency_edges(_both(s, d)[1], with_types=False)
    node = lambda c: F.concat_ws("\u0001", "source", c)
    found = graph.cycles(graph.scc(e.select(node("src").alias("src"), node("dst").alias("dst"))))
    return found.select(F.substring_index("first", "\u0001", 1).alias("source"), F.substring_index("first", "\u0001", -1).alias("first"), "size")


def _link(s, d):
    facts = cut(_facts(s, d))
    c = link.classify(X.consumes(facts), X.provides(facts), [])
    return c.select("source", "key", "file", "line", "bucket")


def _degrees(s, d):
    facts, edges = _both(s, d)
    e = X.dependency_edges(edges)
    ends = e.select("source", F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select("source", F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("source", "path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def queries() -> dict:
    return {
        "facts_symbols": _of("symbol", "end_line", "name", "kind", "exported"),
        "facts_imports": _of("import", "name", "kind", "target", "detail"),
        "facts_routes": _of("route", "kind", "target", "name"),
        "facts_egress": _of("egress", "kind", "target", "name"),
        "facts_calls": _of("call", "name", "target"),
        "facts_sites": _of("site", "kind", "name"),
        "facts_provides": lambda s, d: X.provides(_facts(s, d)).distinct(),
        "facts_link": _link,
        "import_edges": lambda s, d: _both(s, d)[1],
        "import_degrees": _degrees,
        "unresolved_imports": lambda s, d: X.unresolved_imports(*_both(s, d)),
        "import_cycles": _cycles,
        "dead_exports": lambda s, d: X.dead_exports(*_both(s, d)),
        "symbol_graph": lambda s, d: _graph(s, d)[2],
        "mutating_without_auth": lambda s, d: X.mutating_routes_without_auth(*_graph(s, d)),
        "unsafe_reads": lambda s, d: X.unsafe_reads(*_graph(s, d)),
    }


_LINES = """WITH l AS (SELECT source, path, lower(regexp_extract(path, '[.](\\w+)$', 1)) AS ext, unnest(a) AS t, CAST(generate_subscripts(a, 1) AS INT) AS line
  FROM (SELECT source, path, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(65279), ''), chr(10)) AS a FROM files WHERE text IS NOT NULL AND path IS NOT NULL)),
n AS (SELECT *, lead(t) OVER (PARTITION BY source, path ORDER BY line) AS t2 FROM (SELECT DISTINCT * FROM l)),
js AS (SELECT * FROM n WHERE ext IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'mts', 'cts')),
"""
_ROUTES = r"""routes AS (
  SELECT source, path, line, upper(regexp_extract(t, '^\s*app[.](\w+)\(', 1)) AS kind, regexp_extract(t, '\(''([^'']*)''', 1) AS target, regexp_extract(t, ', ?(\w+)\)', 1) AS name
  FROM js WHERE regexp_matches(t, '^\s*app[.](get|post|put|patch|delete)\(''[^'']*'', ?\w+\);')
  UNION SELECT source, path, line, upper(regexp_extract(t, '@(\w+)Mapping', 1)), trim(regexp_extract(t, '"([^"]*)"', 1), '/'), regexp_extract(t2, '(\w+)\s*\(', 1) FROM n WHERE ext = 'java' AND regexp_matches(t, '^\s*@(Get|Post|Put|Patch|Delete)Mapping\("[^"]*"\)')
  UNION SELECT source, path, line, 'ALL', regexp_extract(t, '"([^"]*)"', 1), regexp_extract(t, ', ?(\w+)\)', 1) FROM n WHERE ext = 'go' AND regexp_matches(t, '^\s*mux[.]HandleFunc\("[^"]*", ?\w+\)'))
"""
_IMPORTS = r"""imports AS (
  SELECT source, path, line, regexp_extract(t, '\{ (\w+) \}', 1) AS name, 'value' AS kind, regexp_extract(t, 'from ''([^'']+)''', 1) AS target,
    CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '[^/]*$', '') ELSE '' END || regexp_extract(t, 'from ''[.]/([^'']+)''', 1) AS detail FROM js WHERE regexp_matches(t, '^\s*import \{ \w+ \} from ''[.]/[^'']+'';')
  UNION SELECT source, path, line, '*', 'value', regexp_extract(t, '^\s*import ([\w.]+)', 1), replace(regexp_extract(t, '^\s*import ([\w.]+)', 1), '.', '/') FROM n WHERE ext = 'py' AND regexp_matches(t, '^\s*import [\w.]+\s*$')
  UNION SELECT source, path, line, '*', 'value', regexp_extract(t, '^\s*use ([\w:]*\w)', 1), NULL FROM n WHERE ext = 'rs' AND regexp_matches(t, '^\s*use [\w:]+'))
"""
_EDGES = f"""{_LINES}{_IMPORTS}, e AS (SELECT DISTINCT i.source, i.path AS src, f.path AS dst, i.name, i.kind, list_position(['ts', 'tsx', 'mts', 'cts', 'js', 'jsx', 'mjs', 'cjs', 'py', 'pyi', 'rs'], regexp_extract(f.path, '[.](\\w+)$', 1)) AS place
  FROM imports i JOIN flat f ON f.source = i.source AND regexp_replace(f.path, '[.]\\w+$', '') = i.detail),
edges AS (SELECT source, src, dst, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY source, src, name, kind ORDER BY place) AS n FROM e WHERE place IS NOT NULL) WHERE n = 1)"""


def oracle_sql() -> dict[str, str]:
    lines = _LINES
    flat = f"WITH named AS ({FLAT}), flat AS (SELECT n.source, n.path, min(f.text) AS text FROM named n JOIN files f ON f.source = n.source AND f.path = n.own GROUP BY 1, 2), "
    edges = flat + _EDGES.replace("FROM files", "FROM flat", 1).replace("WITH ", "", 1)
    return {
        "facts_routes": f"{lines}{_ROUTES} SELECT DISTINCT source, path, line, kind, target, name FROM routes",
        "facts_imports": f"{lines}{_IMPORTS} SELECT DISTINCT source, path, line, name, kind, target, detail FROM imports",
        "import_edges": f"{edges} SELECT source, src, dst, name, kind FROM edges",
        "import_degrees": f"""{edges}, d AS (SELECT DISTINCT source, src, dst FROM edges WHERE src <> dst)
          SELECT source, path, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT source, src AS path, 0 AS i, 1 AS o FROM d UNION ALL SELECT source, dst, 1, 0 FROM d) GROUP BY ALL""",
        "unresolved_imports": f"""{edges} SELECT DISTINCT source, path, target FROM imports i WHERE target LIKE '.%' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = i.source AND e.src = i.path AND e.name = i.name AND e.kind = i.kind)""",
        "facts_provides": f"""{lines}{_ROUTES}, v AS (SELECT *, unnest(CASE WHEN kind = 'ALL' THEN ['GET', 'POST', 'PUT', 'PATCH', 'DELETE'] ELSE [kind] END) AS verb FROM routes)
          SELECT source, 'http' AS kind, verb || ' /' || trim(target, '/') AS key, path AS file, line, name AS symbol FROM v""",
    }
