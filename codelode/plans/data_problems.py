"""Queries of the general data problems (3, 5 and 6), and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators import copydiff, drift, nested
from codelode.session import table

REDIS_FIELDS = ["severity", "message", "matcher_type", "line_pattern", "skip_comment_lines", "snippet_max"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copydiff.diff_copies(
        table(spark, d, "redis_pre_migration"), table(spark, d, "redis"), "id", REDIS_FIELDS, "revised_at",
        "redis_pre_migration", "redis",
    )


def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    return copydiff.diff_summary(p3_found(spark, d))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return nested.rule_pack_groups(table(spark, d, "sql_packs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = nested.pattern_table(_groups(spark, d)).where(F.col("rule_id").isNotNull() & F.col("pack_key").isNotNull())
    return found.select("pack_key", "pack_pos", "rule_pos", "rule_id", "list_name", "item_pos").distinct()


def p5_packs(spark: SparkSession, d: str) -> DataFrame:
    return nested.pack_table(_groups(spark, d))


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    return nested.rule_table(_groups(spark, d))


def p5_patterns(spark: SparkSession, d: str) -> DataFrame:
    return nested.pattern_table(_groups(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "pack_files"), "file_key", ["source", "path"], "written_at", "body")


def p6_union(spark: SparkSession, d: str) -> DataFrame:
    return drift.union_table(table(spark, d, "pack_files"), "file_key", "body")


def queries() -> dict:
    return {
        "p3_found": p3_found,
        "p3_summary": p3_summary,
        "p5_found": p5_found,
        "p5_packs": p5_packs,
        "p5_rules": p5_rules,
        "p5_patterns": p5_patterns,
        "p6_found": p6_found,
        "p6_union": p6_union,
    }


def _p3_sql() -> str:
    current = """
    {t}_now AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY revised_at DESC NULLS LAST) AS rn
        FROM {t} WHERE id IS NOT NULL) WHERE rn = 1)"""
    differs = " UNION ALL ".join(
        f"SELECT a.id, '{c}' AS field, 'differs' AS status FROM redis_pre_migration_now a JOIN redis_now b ON a.id = b.id "
        f"WHERE a.{c} IS DISTINCT FROM b.{c}"
        for c in REDIS_FIELDS
    )
    return f"""WITH {current.format(t='redis_pre_migration')}, {current.format(t='redis')}
    SELECT id, 'id' AS field, 'missing_in_redis' AS status FROM redis_pre_migration_now WHERE id NOT IN (SELECT id FROM redis_now)
    UNION ALL
    SELECT id, 'id', 'missing_in_redis_pre_migration' FROM redis_now WHERE id NOT IN (SELECT id FROM redis_pre_migration_now)
    UNION ALL {differs}"""


def oracle_sql() -> dict[str, str]:
    found = _p3_sql()
    return {
        "p3_found": found,
        "p3_summary": f"SELECT field, status, count(*) AS n FROM ({found}) GROUP BY field, status",
    }
