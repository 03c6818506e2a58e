"""Relations of the engine made from the test tables; one text for both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import spread, table

_PATH = "'/api/v' || (p_size % 2 + 1) || '/' || replace(lower(p_brand), '#', '-') || '/p' || p_partkey"

PROVIDES = f"""
SELECT 'n' || (p_partkey % 25) AS source, 'http' AS kind,
  CASE WHEN p_size = 7 THEN 'GET /files' || (p_partkey % 3) || '/**' ELSE 'GET ' || {_PATH} END AS key,
  'src/m' || (p_partkey % 40) || '.ts' AS file, p_partkey AS line, 'h' || p_partkey AS symbol
FROM part
UNION ALL
SELECT 'n' || ((p_partkey + 3) % 25), 'http', 'GET ' || {_PATH}, 'src/x' || (p_partkey % 40) || '.ts', p_partkey, 'x' || p_partkey
FROM part WHERE p_size >= 46
UNION ALL
SELECT 'n' || (p_partkey % 25), 'http', 'DELETE ' || {_PATH}, 'src/d' || (p_partkey % 40) || '.ts', p_partkey, 'd' || p_partkey
FROM part WHERE p_size <= 9"""

CONSUMES = f"""
SELECT l_orderkey * 100 + l_linenumber AS id, 'c' || (o_custkey % 5) AS source, 'http' AS kind,
  CASE (l_orderkey + l_linenumber) % 12
    WHEN 0 THEN NULL
    WHEN 1 THEN 'GET https://vendor' || (l_partkey % 9) || CASE WHEN l_suppkey % 2 = 0 THEN '.one' ELSE '.two' END || '.example' ||
      CASE WHEN l_suppkey % 10 = 0 THEN {_PATH} ELSE '/v' || (l_partkey % 2 + 1) || '/x' || (l_suppkey % 5) END
    WHEN 2 THEN 'GET /{{}}'
    WHEN 3 THEN 'POST ' || {_PATH}
    WHEN 4 THEN 'GET /api/v' || (2 - p_size % 2) || '/' || replace(lower(p_brand), '#', '-') || '/p' || p_partkey
    WHEN 5 THEN 'GET /API/v' || (p_size % 2 + 1) || '/' || replace(lower(p_brand), '#', '-') || '/P' || p_partkey
    WHEN 6 THEN 'GET /v' || (p_size % 2 + 1) || '/' || replace(lower(p_brand), '#', '-') || '/p' || p_partkey
    WHEN 7 THEN 'GET /files' || (l_partkey % 3) || '/a/' || l_partkey
    WHEN 8 THEN 'GET https://Internal.example:8443' || {_PATH} || '/?q=1'
    ELSE 'GET ' || {_PATH} END AS key,
  'ui/f' || (l_suppkey % 60) || '.ts' AS file, l_orderkey * 10 + l_linenumber AS line
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

HOSTS = ["internal.example"]
LOW_CONFIDENCE = [(r"^GET /api/v1/brand-1\d/", "generic path"), (r"/p\d$", "short name")]

#: a commit is an order, a file a supplier
COMMIT_FILES = """
SELECT o_orderkey AS sha, o_orderdate AS ts, o_custkey AS author, 's/' || (l_suppkey % 7) || '/t' || (l_suppkey % 3) || '/f' || l_suppkey || '.ts' AS path,
  CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted, CASE l_returnflag WHEN 'R' THEN 'FIX' WHEN 'A' THEN 'FEAT' END AS tag
FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""

#: imports between parts: sparse, with cycles and self-loops
DEP_EDGES = """
SELECT DISTINCT src, dst FROM (
  SELECT p_partkey AS src, 1 + (p_partkey * 7 + p_size) % (SELECT max(p_partkey) FROM part) AS dst FROM part
  UNION ALL
  SELECT p_partkey, CAST(1 + floor(p_partkey / 2.0) AS BIGINT) FROM part WHERE p_size > 25
  UNION ALL
  SELECT p_partkey, p_partkey FROM part WHERE p_size = 50) e"""

#: a file of the import graph, with its folders and length
NODES = """
SELECT p_partkey AS id, 'pkg' || (p_partkey % 5) || '/m' || (p_partkey % 23) || '/' || lower(replace(p_brand, '#', '-')) || '/f' || p_partkey || '.ts' AS path,
  CAST(p_size * 9 AS BIGINT) AS loc FROM part"""

RELATIONS = {"provides": PROVIDES, "consumes": CONSUMES, "commit_files": COMMIT_FILES, "dep_edges": DEP_EDGES, "nodes": NODES}
_NAMES = ("region nation customer supplier part orders lineitem events documents files findings rule_defs arch redis redis_pre_migration pack_files").split()


def relation(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A relation as a DataFrame; its tables are bound to the query itself, not to the session's catalog."""
    import re

    text = RELATIONS[name]
    used = [t for t in _NAMES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    braces = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        braces = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", braces)
    df = spark.sql(braces, **{t: spread(table(spark, d, t)) if t == "lineitem" else table(spark, d, t) for t in used})
    # a generator, so that later projections don't copy the binding's expressions over and over
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def ctes(*names: str) -> str:
    """The same relations as the head of an SQL text."""
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names)
