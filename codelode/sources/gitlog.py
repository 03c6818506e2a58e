"""Commit history from the text of `git log --numstat` with headers `\\x1fsha\\x1fdate\\x1fauthor\\x1fsubject`.

Each row holds the log of some commits, header lines first; rows are parsed apart,
so a long history is split into rows at its headers.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S

_BRACES = re.compile(r"\{([^{}]*) => ([^{}]*)\}")


def canonical(path: str) -> tuple[str, str | None]:
    """(path now, path before): `a/{b => c}/d` and `a => b` are renames."""
    if "=>" not in path:
        return path, None
    if _BRACES.search(path):
        old, new = (_BRACES.sub(rf"\{g}", path).replace("//", "/") for g in (1, 2))
    else:
        old, _, new = path.partition(" => ")
    return new.strip(), old.strip()


def parse_log(text: str) -> Iterator[tuple]:
    """(sha, date, author, subject, path, old_path, added, deleted); binary files are passed over."""
    head: tuple = ()
    for line in text.split("\n"):
        if line.startswith("\x1f"):
            head = tuple((line[1:].split("\x1f", 3) + [""] * 4)[:4])
            continue
        part = line.split("\t", 2)
        if len(part) == 3 and head and part[0].isdigit() and part[1].isdigit():
            path, old = canonical(part[2])
            yield (*head, path, old, int(part[0]), int(part[1]))


_SCHEMA = pa.schema([("sha", pa.string()), ("date", pa.string()), ("author", pa.string()), ("subject", pa.string()), ("path", pa.string()), ("old_path", pa.string()), ("added", pa.int64()), ("deleted", pa.int64())])


def commit_files(logs: DataFrame, text: str) -> DataFrame:
    def read(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                rows = list(parse_log(t or ""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    out = logs.select(F.col(f"`{text}`").alias("t")).mapInArrow(read, "sha string, date string, author string, subject string, path string, old_path string, added long, deleted long")
    return out.withColumn("ts", F.try_to_timestamp("date")).withColumn("tags", S.commit_tags(F.col("subject")))


def rebase(files: DataFrame, prefix: str) -> DataFrame:
    """Paths under the prefix, relative to it; others are dropped, as they belong to another tree."""
    p = prefix.rstrip("/") + "/"
    return files.where(F.col("path").startswith(p)).withColumn("path", F.substr("path", F.lit(len(p) + 1)))


def read_repository(path: str) -> str:
    """The log of a local repository."""
    fmt = "--pretty=format:%x1f%H%x1f%aI%x1f%an%x1f%s"
    return subprocess.run(["git", "-C", path, "log", "--no-merges", "-M", "--reverse", "--numstat", fmt], capture_output=True, text=True, check=True).stdout
