"""Queries of the text operators, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import leakage, markup, mixing, proseincode, residue, similar
from codelode.session import table


def _sql_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rule_defs").where(F.col("pack").isin("sql", "sql-preferences"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar.alike_pairs(_sql_rules(spark, d), "rule_key", "message")
    return pairs.select(F.col("a").alias("rule_key_a"), F.col("b").alias("rule_key_b"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return similar.alike_members(_sql_rules(spark, d), "rule_key", "message")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p1_passages(spark: SparkSession, d: str) -> DataFrame:
    return proseincode.prose(table(spark, d, "files"), "file_id", "path", "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = p1_passages(spark, d).where(F.col("file_id").isNotNull())
    return found.select("file_id", "line_no", "origin", "lang").distinct()


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return proseincode.language_shares(p1_passages(spark, d), "file_id")


def _marked_up(spark: SparkSession, d: str) -> DataFrame:
    arch = table(spark, d, "arch")
    react = table(spark, d, "findings").where(F.col("rule_id").startswith("react/"))
    parts = [
        df.where(F.col(key).isNotNull()).select(
            F.lit(origin).alias("origin"), F.col(key).alias("row_id"), F.lit(field).alias("field"), F.col(field).alias("value")
        )
        for df, origin, key, field in (
            (arch, "arch", "arch_id", "ko"), (arch, "arch", "arch_id", "en"), (react, "findings", "finding_id", "message"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found_structures(_marked_up(spark, d)).distinct()


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(_marked_up(spark, d)).distinct()


def _mix(spark: SparkSession, d: str, tokenizer: str | None, of_corpus: float | None = None) -> tuple[DataFrame, DataFrame]:
    counted = mixing.count_tokens(table(spark, d, "documents"), "doc_id", "source", "text", tokenizer or mixing.tokenizer_path())
    return mixing.mix(counted, table(spark, d, "mix_targets"), of_corpus=of_corpus)


def p8_mix(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    return _mix(spark, d, tokenizer)[0].withColumnRenamed("k", "doc_id")


def p8_shares(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    return _mix(spark, d, tokenizer)[1]


def p8_tempered(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    """A mix as large as the corpus, as close to the targets as the repeats allow."""
    return _mix(spark, d, tokenizer, 1.0)[0].withColumnRenamed("k", "doc_id")


def p8_tempered_shares(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    return _mix(spark, d, tokenizer, 1.0)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents").where(F.col("doc_id").isNotNull()), "doc_id", "text")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "source", "n_chars")


def queries() -> dict:
    return {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_tempered": p8_tempered, "p8_tempered_shares": p8_tempered_shares, "p9_found": p9_found, "p9_kept": p9_kept, "p2_found": p2_found, "p2_clean": p2_clean, "p1_found": p1_found, "p1_passages": p1_passages, "p1_shares": p1_shares, "p4_found": p4_found, "p4_members": p4_members, "p7_found": p7_found, "p7_leaks": p7_leaks}


_P4_SQL = r"""
WITH w AS (
  SELECT rule_key, unnest(regexp_extract_all(lower(message), '[\p{L}\p{Nd}]+')) AS word
  FROM rule_defs WHERE pack IN ('sql', 'sql-preferences')),
c AS (SELECT rule_key, word, count(*) AS n FROM w GROUP BY ALL),
t AS (SELECT rule_key, sum(n) AS total FROM c GROUP BY rule_key),
o AS (
  SELECT a.rule_key AS rule_key_a, b.rule_key AS rule_key_b, sum(least(a.n, b.n)) AS shared
  FROM c a JOIN c b ON a.word = b.word AND a.rule_key < b.rule_key GROUP BY 1, 2)
SELECT rule_key_a, rule_key_b FROM o
JOIN t x ON x.rule_key = rule_key_a JOIN t y ON y.rule_key = rule_key_b
WHERE shared >= 0.75 * (x.total + y.total - shared)"""

_P7_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS ws FROM eval_items),
n AS (SELECT item_id, ws, least(len(ws), 12) AS size FROM i WHERE len(ws) > 0),
iw AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[p : p + size - 1], ' ') AS win
  FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM n)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS ws FROM documents),
dw AS (
  SELECT DISTINCT doc_id, size, array_to_string(ws[p : p + size - 1], ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p
        FROM d, (SELECT DISTINCT size FROM n) WHERE len(ws) >= size))
SELECT doc_id, item_id, count(*) AS windows FROM dw JOIN iw USING (size, win) GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4_SQL,
        "p7_found": f"SELECT doc_id, item_id FROM ({_P7_SQL})",
        "p7_leaks": _P7_SQL,
    }
