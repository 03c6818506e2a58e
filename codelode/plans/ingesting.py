"""Queries of the sources, the composition and the incremental store."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import routes
from codelode.plans.bindings import ctes, relation
from codelode.session import table
from codelode.sources import code, envelope, gitlog
from codelode.streaming import incremental


def _sql_files(s, d):
    return table(s, d, "files").where(F.col("path").rlike(r"(?i)\.sql$"))


def git_log_parse(s, d):
    """Writes the bound history as the text of a log and reads it back."""
    f = relation(s, d, "commit_files")
    line = F.concat_ws("\t", F.col("added").cast("string"), F.col("deleted").cast("string"), "path")
    head = F.concat_ws("\x1f", F.lit(""), F.col("sha").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("author").cast("string"), F.lit("fix(x): y"))
    logs = f.withColumn("h", head).withColumn("l", line).groupBy("h").agg(F.concat(F.col("h"), F.lit("\n"), F.array_join(F.sort_array(F.collect_list("l")), "\n")).alias("text"))
    return gitlog.commit_files(logs, "text").groupBy("path").agg(F.count("*").alias("rows"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max("ts").alias("last"))


def envelope_provides(s, d):
    """Packs the bound provides into one envelope per source and file, and reads them back."""
    p = relation(s, d, "provides")
    io = F.struct(F.collect_list(F.struct("kind", "key", "line", "symbol")).alias("provides"))
    f = p.groupBy("source", "file").agg(io.alias("io"))
    e = F.to_json(F.struct(F.lit(envelope.FORMAT).alias("format"), F.lit(envelope.VERSION).alias("version"), F.lit("t").alias("parser"), "source", F.array(F.struct(F.col("file").alias("path"), "io")).alias("files")))
    parsed = envelope.parse(f.select(e.alias("text"), F.lit(1).alias("k")), "k", "text")
    return envelope.provides(parsed).select("source", "file", "kind", "key", "line", "symbol")


def queries() -> dict:
    return {
        "sql_tables": lambda s, d: code.sql_tables(code.sql_statements(_sql_files(s, d))).groupBy("table_name").agg(F.count_distinct("path").alias("files"), F.count("*").alias("statements")),
        "sql_tables_shared": lambda s, d: code.sql_tables(code.sql_statements(_sql_files(s, d))).groupBy("table_name").agg(F.count_distinct("source").alias("sources")).where("sources >= 2"),
        "python_symbols": lambda s, d: code.python_files(table(s, d, "files")).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")),
        "git_log_parse": git_log_parse,
        "envelope_provides": envelope_provides,
        "route_shadowing": lambda s, d: routes.shadowed_in_file(
            relation(s, d, "provides").withColumn("key", F.when(F.col("line") % 3 == 0, F.regexp_replace("key", "/p[0-9]+$", "/{}")).otherwise(F.col("key")))
        ).select("source", "file", "key", "line", "by_line"),
        "incremental_unseen": lambda s, d: incremental.unseen(
            table(s, d, "files").where(F.col("scanned_at") >= F.lit("2025-06-01").cast("timestamp")),
            incremental.keyed(table(s, d, "files").where(F.col("scanned_at") < F.lit("2025-06-01").cast("timestamp")), "1"), "1",
        ).select("file_id", "content_key"),
        "commit_feed": lambda s, d: incremental.commit_feed(relation(s, d, "commit_files").withColumn("ts", F.col("ts").cast("timestamp"))),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "git_log_parse": ctes("commit_files") + " SELECT path, count(*) AS rows, sum(added) AS added, sum(deleted) AS deleted, max(ts) AS last FROM commit_files GROUP BY path",
        "envelope_provides": ctes("provides") + " SELECT source, file, kind, key, CAST(line AS INT) AS line, symbol FROM provides",
        "route_shadowing": ctes("provides")
        + r""", p AS (SELECT source, file, line, CASE WHEN line % 3 = 0 THEN regexp_replace(key, '/p[0-9]+$', '/{}') ELSE key END AS key FROM provides WHERE key NOT LIKE '%*%')
          SELECT b.source, b.file, b.key, b.line, min(a.line) AS by_line FROM p a JOIN p b ON a.source = b.source AND a.file = b.file AND a.line < b.line AND a.key LIKE '%{}' AND b.key NOT LIKE '%{}'
            AND regexp_replace(b.key, '/[^/]*$', '/{}') = a.key GROUP BY ALL""",
        "incremental_unseen": r"""WITH k AS (SELECT file_id, scanned_at, sha256(concat_ws(chr(0), path, coalesce(text, ''), '1')) AS content_key FROM files)
          SELECT file_id, content_key FROM k WHERE scanned_at >= TIMESTAMP '2025-06-01 00:00:00' AND content_key NOT IN (SELECT content_key FROM k WHERE scanned_at < TIMESTAMP '2025-06-01 00:00:00')""",
        "commit_feed": ctes("commit_files")
        + """ SELECT time_bucket(INTERVAL 7 DAYS, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00') AS start, path, count(*) AS changes, sum(added + deleted) AS churn FROM commit_files GROUP BY 1, 2""",
    }
