"""Lexical readers: tables of SQL text, Prisma models, file-convention routes, and Python's own syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S


def sql_statements(files: DataFrame) -> DataFrame:
    """(source, path, n, statement): comments removed, split at semicolons outside of quotes."""
    t = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), r"(?m)(?:--|//)[^\n']*$", "")
    t = F.regexp_replace(t, r"/\*[\s\S]*?\*/", "")
    parts = F.split(t, r";(?=(?:[^']*'[^']*')*[^']*$)")
    return (
        files.where(F.col("text").isNotNull()).select("source", "path", F.posexplode(parts).alias("n", "s"))
        .select("source", "path", "n", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("statement")).where(F.col("statement") != "")
    )


_TOUCH = r"(?i)\b(?:from|join|into|update|table(?: if (?:not )?exists)?)\s+([a-z_][\w.]*)"


def sql_tables(statements: DataFrame) -> DataFrame:
    """(source, path, n, table_name): tables a statement names."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("statement", F.lit(_TOUCH), F.lit(1)), F.lower))
    return statements.select("source", "path", "n", F.explode(names).alias("table_name"))


def sql_provides(statements: DataFrame) -> DataFrame:
    """(source, path, n, table_name): tables a statement creates, temporary ones aside."""
    name = F.regexp_extract("statement", r"(?i)^create (?:or replace )?(?!temp)(?:\w+ )?table (?:if not exists )?([a-z_][\w.]*)", 1)
    temp = F.col("statement").rlike(r"(?i)^create (?:or replace )?(?:local |global )?temp")
    return statements.where((name != "") & ~temp).select("source", "path", "n", F.lower(name).alias("table_name"))


def convention_route(path: Column) -> Column:
    """The route of a page file: pages/ and app/ folders, `[x]` segments as placeholders; null for other files."""
    hit = F.regexp_extract(path, r"(?:^|/)(?:pages|app)/(.*?)(?:/?(?:index|page|route))?\.(?:tsx?|jsx?|mjs)$", 1)
    r = F.regexp_replace(F.regexp_replace(hit, r"\[\[?\.\.\.\w+\]?\]", "**"), r"\[\w+\]", "{}")
    r = F.regexp_replace(r, r"(^|/)\([^)]*\)", "")
    return F.when(path.rlike(r"(?:^|/)(?:pages|app)/.*\.(?:tsx?|jsx?|mjs)$"), S.normalize_http_path(r))


def prisma_models(texts: DataFrame) -> DataFrame:
    """(source, path, model, field, type, is_list, is_optional, attributes) of each model field."""
    pattern = r"(?m)^model\s+\w+\s*\{[^}]*\}"
    m = texts.select("source", "path", F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("b"))
    m = m.withColumn("model", F.regexp_extract("b", r"^model\s+(\w+)", 1)).withColumn("l", F.explode(F.split("b", "\n")))
    f = r"^\s+(\w+)\s+(\w+)(\[\])?(\?)?\s*(.*)$"
    return m.where(F.col("l").rlike(f) & ~F.col("l").rlike(r"^\s*(//|@@)")).select(
        "source", "path", "model", F.regexp_extract("l", f, 1).alias("field"), F.regexp_extract("l", f, 2).alias("type"), (F.regexp_extract("l", f, 3) != "").alias("is_list"),
        (F.regexp_extract("l", f, 4) != "").alias("is_optional"), F.trim(F.regexp_extract("l", f, 5)).alias("attributes"),
    )


def model_issues(fields: DataFrame, most_fields: int = 15) -> DataFrame:
    """(model, issue) of the structural checks on models."""
    g = fields.groupBy("source", "model").agg(
        F.count("*").alias("n"),
        F.bool_or((F.col("field") == "createdAt") | ((F.col("type") == "DateTime") & F.col("attributes").contains("now()"))).alias("created"),
        F.bool_or(F.lower("type").isin("float", "double", "real") & F.col("field").rlike(r"(?i)price|amount|total|cost|balance")).alias("money"),
        F.bool_or((F.col("field") == "updatedAt") & ~F.col("attributes").contains("@updatedAt")).alias("stale"),
        F.bool_or((F.col("type") == "String") & F.col("field").rlike(r"(At|Date|Time)$")).alias("temporal"),
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("n") >= most_fields, "god-model"), F.when((F.col("n") > 3) & ~F.col("created"), "missing-timestamps"), F.when(F.col("money"), "float-money"),
            F.when(F.col("stale"), "stale-updated-at"), F.when(F.col("temporal"), "temporal-string"),
        )
    )
    return g.select("source", "model", F.explode(found).alias("issue"))


_PY = pa.schema([("i", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("target", pa.string())])
_VERBS = {"get", "post", "put", "delete", "patch"}


def python_facts(text: str) -> Iterator[tuple[str, str, int, int, str | None]]:
    """(kind, name, line, end, target) of functions, classes, imports, calls, and routes set by decorators."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            yield "function", n.name, n.lineno, n.end_lineno or n.lineno, None
            for d in n.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in _VERBS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                    yield "route", n.name, d.lineno, d.lineno, f"{d.func.attr.upper()} {d.args[0].value}"
        elif isinstance(n, ast.ClassDef):
            yield "class", n.name, n.lineno, n.end_lineno or n.lineno, None
        elif isinstance(n, ast.Import):
            for a in n.names:
                yield "import", a.asname or a.name, n.lineno, n.lineno, a.name
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                yield "import", a.asname or a.name, n.lineno, n.lineno, "." * n.level + (n.module or "") + ":" + a.name
        elif isinstance(n, ast.Call):
            f = n.func
            yield "call", f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "?"), n.lineno, n.end_lineno or n.lineno, None


def python_files(files: DataFrame) -> DataFrame:
    """(source, path, kind, name, line, end_line, target) of the .py files; unreadable ones give nothing."""

    def read(batches):
        for batch in batches:
            rows = [(i, *x) for i, t in enumerate(batch.column(2).to_pylist()) for x in python_facts(t)]
            if rows:
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PY, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(cols[0]), batch.column(1).take(cols[0]), *cols[1:]], names=["source", "path", "kind", "name", "line", "end_line", "target"])

    return files.where(F.col("path").rlike(r"(?i)\.py$") & F.col("text").isNotNull()).select("source", "path", "text").mapInArrow(
        read, "source string, path string, kind string, name string, line long, end_line long, target string"
    )
