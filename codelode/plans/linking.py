"""Queries of the link, its leftovers and the near misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.operators import link, nearmiss, routes
from codelode.plans.bindings import HOSTS, LOW_CONFIDENCE, ctes, relation
from codelode.session import cut


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    provides = relation(s, d, "provides")
    return relation(s, d, "consumes"), provides, link.classify(relation(s, d, "consumes"), provides, HOSTS)


def _misses(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, provides, c = _sides(s, d)
    # each rule reads the misses several times; the link itself is run once
    return cut(c.where(F.col("bucket") == "unprovided").select("id", "source", "join_key")), cut(provides)


def link_buckets(s, d):
    return _sides(s, d)[2].select("id", "source", "join_key", "bucket")


def link_edges(s, d):
    _, p, c = _sides(s, d)
    return link.edges(c, p, LOW_CONFIDENCE)


def link_unconsumed(s, d):
    _, p, c = _sides(s, d)
    return link.unconsumed(c, p).select("source", "key", "file", "line", "symbol")


def link_ambiguous(s, d):
    _, p, c = _sides(s, d)
    return link.ambiguous(c, p)


def link_wildcards(s, d):
    _, p, c = _sides(s, d)
    return link.wildcard_partitions(c, p)


def link_host_rekeys(s, d):
    return link.host_rekeys(_sides(s, d)[2])


def miss_method(s, d):
    return nearmiss.method_mismatch(*_misses(s, d))


def miss_version(s, d):
    return nearmiss.version_skew(*_misses(s, d))


def miss_route(s, d):
    return nearmiss.route_near_miss(*_misses(s, d))


def miss_prefix_drift(s, d):
    return nearmiss.prefix_drift(nearmiss.prefix_miss(*_misses(s, d)))


def miss_path(s, d):
    return nearmiss.path_near_miss(*_misses(s, d))


def duplicate_route(s, d):
    return routes.duplicate_sources(relation(s, d, "provides"))


def external_shadows_internal(s, d):
    c, p, _ = _sides(s, d)
    return routes.external_shadows_internal(link.rekeyed(c, HOSTS), p)


def external_hosts(s, d):
    return routes.host_fanout(link.rekeyed(relation(s, d, "consumes"), HOSTS))


def base_url_drift(s, d):
    return routes.base_url_drift(link.rekeyed(relation(s, d, "consumes"), HOSTS))


def version_inconsistency(s, d):
    return routes.version_inconsistency(link.rekeyed(relation(s, d, "consumes"), HOSTS))


def unresolved_ratio(s, d):
    return routes.unresolved_ratio(_sides(s, d)[2])


def unjoined_sources(s, d):
    return routes.unjoined_sources(_sides(s, d)[2])


def unprovided_mutations(s, d):
    m, _ = _misses(s, d)
    return m.where(S.verb(F.col("join_key")).isin("POST", "PUT", "PATCH", "DELETE")).select("id", "source", "join_key")


def unconsumed_capped(s, d):
    _, p, c = _sides(s, d)
    return routes.capped(link.unconsumed(c, p), "source", ["key", "file", "line"], 25)


def queries() -> dict:
    return {
        "link": link_buckets, "link_edges": link_edges, "link_unconsumed": link_unconsumed, "link_ambiguous": link_ambiguous, "link_wildcards": link_wildcards,
        "link_host_rekeys": link_host_rekeys, "miss_method": miss_method, "miss_version": miss_version, "miss_route": miss_route, "miss_prefix_drift": miss_prefix_drift,
        "miss_path": miss_path, "duplicate_route": duplicate_route, "external_shadows_internal": external_shadows_internal, "external_hosts": external_hosts,
        "base_url_drift": base_url_drift, "version_inconsistency": version_inconsistency, "unresolved_ratio": unresolved_ratio, "unjoined_sources": unjoined_sources,
        "unprovided_mutations": unprovided_mutations, "unconsumed_capped": unconsumed_capped,
    }


_LINK = ctes("provides", "consumes") + r""",
pk AS (SELECT key, count(DISTINCT source) AS n FROM provides WHERE key NOT LIKE '%*%' GROUP BY key),
c1 AS (
  SELECT *, CASE WHEN lower(regexp_extract(key, '^\S+ https?://([^/:?#]*)', 1)) = 'internal.example' THEN 'internal.example' END AS host FROM consumes),
c2 AS (
  SELECT *, CASE WHEN host IS NULL THEN key ELSE regexp_replace(regexp_replace(key, '://[^/]*', '', ''), '^(\S+) https?([^?#]*?)/*([?#].*)?$', '\1 \2') END AS join_key FROM c1),
w AS (SELECT DISTINCT ON (key) key, source, file, line FROM provides WHERE key LIKE '%*%' ORDER BY key, source, file, line),
c AS (
  SELECT c2.*, pk.n, w.source AS w_source, w.file AS w_file, w.line AS w_line, w.key AS w_key,
    CASE WHEN join_key IS NULL THEN 'unresolved' WHEN host IS NULL AND c2.key LIKE '%://%' THEN 'external' WHEN n >= 2 THEN 'ambiguous' WHEN n = 1 THEN 'edge'
      WHEN w.key IS NOT NULL THEN 'wildcard' WHEN join_key = 'GET /{}' THEN 'unresolved' ELSE 'unprovided' END AS bucket
  FROM c2 LEFT JOIN pk ON join_key = pk.key LEFT JOIN w ON join_key LIKE replace(w.key, '**', '%')),
m AS (SELECT * FROM c WHERE bucket = 'unprovided'),
pr AS (SELECT * FROM provides WHERE key NOT LIKE '%*%')
"""


def _best(hits: str) -> str:
    return f"""SELECT id, arg_min(p_source, (p_source, p_file, p_line, p_key)) AS provide_source, arg_min(p_key, (p_source, p_file, p_line, p_key)) AS provide_key,
      count(*) - 1 AS others FROM ({hits}) GROUP BY id"""


_P = "pr.source AS p_source, pr.file AS p_file, pr.line AS p_line, pr.key AS p_key"
_CASE = f"SELECT m.id, {_P} FROM m JOIN pr ON lower(m.join_key) = lower(pr.key) AND m.join_key <> pr.key"
_SEG = "regexp_replace({k}, '^(\\S+) /[^/]+/', '\\1 /')"


def _prefix(m: str) -> str:
    one = r"regexp_replace({k}, '^(\S+) /[^/]+/', '\1 /')"
    two = r"regexp_replace({k}, '^(\S+) /[^/]+/[^/]+/', '\1 /')"
    lead1, lead2 = r"regexp_extract({k}, '^\S+ /([^/]+)/', 1)", r"regexp_extract({k}, '^\S+ /([^/]+/[^/]+)/', 1)"
    parts = []
    for cut, lead in ((one, lead1), (two, lead2)):
        for long, short, missing in (("pr.key", "m.join_key", "true"), ("m.join_key", "pr.key", "false")):
            parts.append(
                f"SELECT m.id, m.source, {lead.format(k=long)} AS prefix, {missing} AS missing, {_P} FROM {m} m JOIN pr ON {cut.format(k=long)} = {short} AND {lead.format(k=long)} <> ''"
            )
    return " UNION ALL ".join(parts)


_EXT = _LINK + r""", x AS (
  SELECT *, lower(regexp_extract(key, '://([^/:?#]*)', 1)) AS h, regexp_extract(key, '://[^/?#]*([^?#]*)', 1) AS path, split_part(key, ' ', 1) AS v
  FROM c WHERE bucket = 'external')"""


def oracle_sql() -> dict[str, str]:
    return {
        "link": _LINK + "SELECT id, source, join_key, bucket FROM c",
        "link_edges": _LINK
        + r"""SELECT c.kind, join_key AS key, c.source AS from_source, c.file AS from_file, c.line AS from_line, pr.source AS to_source, pr.file AS to_file, pr.line AS to_line, symbol,
          c.source <> pr.source AS cross_source, CASE WHEN regexp_matches(join_key, '^GET /api/v1/brand-1\d/') THEN 'generic path' WHEN regexp_matches(join_key, '/p\d$') THEN 'short name' END AS low_confidence_reason
          FROM c JOIN pr ON c.join_key = pr.key WHERE bucket = 'edge'""",
        "link_unconsumed": _LINK + "SELECT source, key, file, line, symbol FROM pr WHERE key NOT IN (SELECT join_key FROM c WHERE bucket IN ('edge', 'ambiguous'))",
        "link_ambiguous": _LINK
        + """SELECT 'http' AS kind, k AS key, consumes, candidates, shown FROM (SELECT join_key AS k, count(*) AS consumes FROM c WHERE bucket = 'ambiguous' GROUP BY 1)
          JOIN (SELECT key, count(*) AS candidates, array_to_string(list_sort(list(source || ':' || file || ':' || line ORDER BY source, file, line)[1:5]), ',') AS shown FROM pr GROUP BY key) ON k = key""",
        "link_wildcards": _LINK
        + """SELECT source, key, file, line, coalesce(n, 0) AS covered FROM (SELECT source, key, file, line FROM provides WHERE key LIKE '%*%')
          LEFT JOIN (SELECT w_source, w_key, w_file, w_line, count(*) AS n FROM c WHERE bucket = 'wildcard' GROUP BY ALL) ON source = w_source AND key = w_key AND file = w_file AND line = w_line""",
        "link_host_rekeys": _LINK + "SELECT host, count(*) AS consumes FROM c WHERE host IS NOT NULL GROUP BY host",
        "miss_method": _LINK
        + _best(f"SELECT m.id, {_P} FROM m JOIN pr ON substr(m.join_key, strpos(m.join_key, ' ')) = substr(pr.key, strpos(pr.key, ' ')) AND split_part(m.join_key, ' ', 1) <> split_part(pr.key, ' ', 1)"),
        "miss_version": _LINK
        + _best(f"SELECT m.id, {_P} FROM m JOIN pr ON regexp_replace(lower(m.join_key), '/v[0-9]+/', '/<v>/') = regexp_replace(lower(pr.key), '/v[0-9]+/', '/<v>/') AND regexp_replace(m.join_key, '/v[0-9]+/', '/<v>/') = regexp_replace(pr.key, '/v[0-9]+/', '/<v>/') AND m.join_key <> pr.key"),
        "miss_route": _LINK
        + f", byc AS ({_best(_CASE)}), rest AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM byc)) SELECT *, 'case' AS how FROM byc UNION ALL SELECT *, 'prefix' FROM ({_best(_prefix('rest'))})",
        "miss_prefix_drift": _LINK
        + f"SELECT source, p_source AS provide_source, prefix, missing, count(DISTINCT id) AS consumes FROM ({_prefix('m')}) GROUP BY ALL HAVING count(DISTINCT id) >= 3",
        "duplicate_route": _LINK + "SELECT key, source, n_sources, sites FROM (SELECT key, source, count(*) AS sites FROM pr GROUP BY ALL) JOIN (SELECT key AS k, n AS n_sources FROM pk WHERE n >= 2) ON k = key",
        "external_shadows_internal": _EXT + "SELECT x.id, x.source, x.h AS host, pr.key, pr.source AS provide_source FROM x JOIN pr ON pr.key = v || ' ' || path",
        "external_hosts": _EXT + "SELECT h AS host, count(DISTINCT source) AS sources, count(DISTINCT (source, file)) AS files, count(*) AS calls FROM x GROUP BY h HAVING count(DISTINCT source) >= 2 OR count(DISTINCT (source, file)) >= 3",
        "base_url_drift": _EXT
        + """, y AS (SELECT path, regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AS domain, count(DISTINCT h) AS hosts, min(h) AS first_host, count(*) AS calls FROM x WHERE length(path) - length(replace(path, '/', '')) >= 2 GROUP BY ALL)
          SELECT * FROM y WHERE hosts >= 2""",
        "version_inconsistency": _EXT
        + """SELECT h AS host, count(DISTINCT path) FILTER (WHERE pinned) AS versioned, count(DISTINCT path) FILTER (WHERE NOT pinned) AS plain, count(DISTINCT source) AS sources
          FROM (SELECT *, regexp_matches(path, '(^|/)v[0-9]+(/|$)') AS pinned FROM x WHERE regexp_matches(path, '/[^/{]')) GROUP BY h HAVING versioned > 0 AND plain > 0""",
        "unresolved_ratio": _LINK + "SELECT source, count(*) AS total, count(*) FILTER (WHERE bucket = 'unresolved') AS unresolved, 2 * count(*) FILTER (WHERE bucket = 'unresolved') >= count(*) AS majority FROM c GROUP BY source HAVING count(*) >= 5",
        "unjoined_sources": _LINK + "SELECT source, count(*) FILTER (WHERE bucket IN ('unprovided', 'ambiguous')) AS waiting, count(*) FILTER (WHERE bucket = 'edge') AS joined FROM c GROUP BY source",
        "unprovided_mutations": _LINK + "SELECT id, source, join_key FROM m WHERE split_part(join_key, ' ', 1) IN ('POST', 'PUT', 'PATCH', 'DELETE')",
        "unconsumed_capped": _LINK
        + """, u AS (SELECT * FROM pr WHERE key NOT IN (SELECT join_key FROM c WHERE bucket IN ('edge', 'ambiguous'))),
          r AS (SELECT source, key, file, line, row_number() OVER (PARTITION BY source ORDER BY key, file, line) AS place, count(*) OVER (PARTITION BY source) AS total FROM u)
          SELECT source, key, file, line, greatest(total - 25, 0) AS folded FROM r WHERE place <= 25""",
    }
