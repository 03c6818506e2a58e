"""Schemas that drift between files: one table, and every change in order.

Each file's header (its fields and their JSON types) is read in parallel. Headers
are folded through a type-promotion lattice into one union schema, to which all
files are cast; consecutive headers of a file are compared for the log of changes.

For the log, rows are dealt out by ranges of (file, time, key), which also cuts up
a file of very many versions, and each task compares its rows in order as they
stream by. What a task can't see is the version before its first row: the last and
the first row of each file in each task come out beside the changes, and the few
pairs across a border are compared at the end.

Defined results
* Null bodies and bodies that hold no JSON object have no fields; they are no
  versions and are passed over. Text nested too deeply to be read counts so too.
* JSON null is absence, an empty object has no fields, an empty array is a value.
* Versions are ordered by time (null first), then key; ties by content. Repeated
  rows change nothing and log nothing.
* A first version logs nothing. Empty tables give empty results.
* Equal numbers are equal values (1 and 1.0); true is not 1.
* Rules without an id take part in which fields exist, not in renames.
* In the union table, fields whose names differ in case only are columns of their
  own: the first by code points keeps its name, the others end in `__2`, `__3` and
  so on (`union_columns` tells which). Integers keep every digit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codelode.session import cut

PACK = ""  # the id under which values of the pack itself are kept
MAX_FIELDS = 20_000  # a wider union schema is refused, as no table could hold it


def json_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "number"
    return "string" if isinstance(v, str) else "array"


def _plain(v):
    """Equal JSON values become equal text."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return int(v)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def _held_as(v) -> str:
    return json.dumps(_plain(v), sort_keys=True)


def leaves(obj: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths to non-object values."""
    stack = [(prefix, obj)]
    while stack:
        at, o = stack.pop()
        for k, v in o.items():
            if isinstance(v, dict):
                stack.append((f"{at}{k}.", v))
            elif v is not None:
                yield at + k, v


def read_object(text: str | None, group: str = "rules") -> tuple[list, list] | None:
    """Leaves of the pack, and of each member of its repeated group; None if it can't be read."""
    try:
        o = json.loads(text.removeprefix("﻿")) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(o, dict):
        return None
    members = o.get(group)
    if isinstance(members, list) and all(isinstance(x, dict) or x is None for x in members):
        own = {k: v for k, v in o.items() if k != group}
        return list(leaves(own)), [list(leaves(x, group + ".")) if x else [] for x in members]
    return list(leaves(o)), []


class Version:
    """What one row says: its fields with their types, and on demand what they hold per rule."""

    def __init__(self, own: list, members: list, group: str, id_name: str) -> None:
        self.own, self.members, self.ident = own, members, f"{group}.{id_name}"
        fields: dict[str, set] = {}
        for part in (own, *members):
            for k, v in part:
                fields.setdefault(k, set()).add(json_type(v))
        self.fields = fields
        self._ids: list[str | None] | None = None

    @staticmethod
    def read(text: str | None, group: str, id_name: str) -> Version | None:
        got = read_object(text, group)
        return None if got is None else Version(*got, group, id_name)

    def idents(self) -> list[str | None]:
        if self._ids is None:
            first = (next((v for k, v in m if k == self.ident), None) for m in self.members)
            self._ids = [None if v is None else json.dumps(v) for v in first]
        return self._ids

    def ids(self) -> set[str]:
        return {i for i in self.idents() if i is not None} | ({PACK} if self.own else set())

    def held(self, names: list[str], shared: set[str]) -> dict[str, dict[str, list[str]]]:
        """By field and id, what it holds."""
        out: dict[str, dict[str, list[str]]] = {n: {} for n in names}
        for ident, part in ((PACK, self.own), *zip(self.idents(), self.members, strict=True)):
            if ident in shared:
                for k, v in part:
                    if k in out:
                        out[k].setdefault(ident, []).append(_held_as(v))
        return out


def changes(old: Version, new: Version) -> list[tuple[str, str, str]]:
    """(change, field, new_field) from one version to the next, in a fixed order."""
    a, b = old.fields, new.fields
    if a == b:
        return []
    gone, come = sorted(k for k in a if k not in b), sorted(k for k in b if k not in a)
    out = [("type_changed", k, "") for k in a if k in b and a[k] != b[k]]
    if gone and come:
        # no field need be held by every rule, so all fields together tell which ids a version has
        shared = old.ids() & new.ids()
        before, after = old.held(gone, shared), new.held(come, shared)
        pairs = [(g, c) for g in gone for c in come if before[g] and before[g] == after[c]]
        out += [("renamed", g, c) for g, c in pairs]
        gone = [k for k in gone if k not in {g for g, _ in pairs}]
        come = [k for k in come if k not in {c for _, c in pairs}]
    out += [("removed", k, "") for k in gone] + [("added", k, "") for k in come]
    return sorted(out)


def schema_changes(df: DataFrame, key: str, parts: list[str], time: str, body: str, group: str = "rules", id_name: str = "id") -> DataFrame:
    """(key, change, field, new_field): each difference from a version to the next."""
    names = [f"p{i}" for i in range(len(parts))]
    rows = df.select(
        *[F.col(f"`{c}`").alias(n) for n, c in zip(names, parts, strict=True)],
        F.col(f"`{time}`").alias("t"), F.col(f"`{key}`").alias("k"), F.col(f"`{body}`").alias("body"),
    ).where(F.col("body").isNotNull())
    kinds = dict(rows.dtypes)
    order = [F.asc_nulls_first(c) for c in (*names, "t", "k", "body")]
    dealt = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in (*names, "t", "k")]).sortWithinPartitions(*order)
    at_key, at_body, p = len(names) + 1, len(names) + 2, len(names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        file, last, edge = None, None, None

        def border(row: tuple, place: int) -> tuple:
            return (*row[:p], row[at_key], None, None, None, task, place, row[at_body])

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = Version.read(row[at_body], group, id_name)
                if version is None:
                    continue
                if edge is None or row[:p] != file:
                    if edge is not None:
                        out.append(border(edge, 1))
                    out.append(border(row, 0))
                    file = row[:p]
                else:
                    out += [(*row[:p], row[at_key], *x, None, None, None) for x in changes(last, version)]
                last, edge = version, row
            if out:
                yield _batch(out)
        if edge is not None:
            yield _batch([border(edge, 1)])

    arrow = pa.schema([])
    for f in (*names, "k"):
        arrow = arrow.append(pa.field(f, to_arrow_type(rows.schema[f].dataType)))
    for f, kind in (("change", pa.string()), ("field", pa.string()), ("new_field", pa.string()), ("task", pa.int64()), ("place", pa.int32()), ("body", pa.string())):
        arrow = arrow.append(pa.field(f, kind))

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in (*names, "k")), "change string, field string, new_field string, task bigint, place int, body string"])
    # a task's first and last row of a file are needed only where the file goes on in another task
    told = cut(dealt.mapInArrow(compare, ddl).where(F.col("change").isNotNull() | F.col("place").isNotNull()))
    borders = told.where(F.col("place").isNotNull())
    several = borders.groupBy(*names).agg(F.min("task").alias("lo"), F.max("task").alias("hi")).where(F.col("lo") < F.col("hi"))
    same = F.lit(True)
    for n in names:
        same = same & borders[n].eqNullSafe(several[n])
    ends = borders.join(several, same, "left_semi")
    before = Window.partitionBy(*names).orderBy("task", "place")  # two rows a task
    across = ends.withColumn("previous", F.lag("body").over(before)).where((F.col("place") == 0) & F.col("previous").isNotNull())
    kind = kinds["k"]

    def compare_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for x in changes(Version.read(a, group, id_name), Version.read(b, group, id_name)):
                    at.append(i)
                    out.append(x)
            cols = [pa.array([x[j] for x in out], pa.string()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names=["k", "change", "field", "new_field"])

    later = across.select("k", "previous", "body").mapInArrow(compare_borders, f"k {kind}, change string, field string, new_field string")
    inner = told.where(F.col("change").isNotNull()).select("k", "change", "field", "new_field")
    return inner.unionByName(later).select(F.col("k").alias(key), "change", "field", "new_field").distinct()


# --- the union table


def header(text: str | None, group: str = "rules") -> list[tuple[str, list[str]]] | None:
    """(field, types) of a body; of numbers, integers are told apart by their width."""
    read = read_object(text, group)
    if read is None:
        return None
    fields: dict[str, set] = {}
    for part in (read[0], *read[1]):
        for k, v in part:
            fields.setdefault(k, set()).add(exact_type(v))
    return [(k, sorted(t)) for k, t in sorted(fields.items())]


def exact_type(v) -> str:
    if isinstance(v, bool) or not isinstance(v, int):
        return json_type(v)
    return "integer" if abs(v) <= 2**53 else "long" if -(2**63) <= v < 2**63 else "big"


def promote(kinds: set[str]) -> str:
    """Least upper bound: integer below long and number, every scalar below string, everything below array.

    Types whose common one would lose digits (integers beyond 2^53 beside
    fractions, or beyond 64 bits) meet in string.
    """
    kinds = kinds - {"null"}
    if "array" in kinds:
        return "array<string>"
    if kinds and kinds <= {"integer", "long"}:
        return "bigint"
    if kinds and kinds <= {"integer", "number"}:
        return "double"
    return "boolean" if kinds == {"boolean"} else "string"


def union_schema(df: DataFrame, body: str, group: str = "rules") -> dict[str, str]:
    """Field -> promoted type, over every file. Its size is that of the schema, at most MAX_FIELDS."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, t) for x in batch.column(0).to_pylist() for k, ts in header(x, group) or () for t in ts}
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.string()) for j in (0, 1)], names=["field", "kind"])

    heads = df.select(F.col(f"`{body}`").alias("body")).mapInArrow(read, "field string, kind string").distinct()
    found = heads.groupBy("field").agg(F.collect_set("kind").alias("kinds")).limit(MAX_FIELDS + 1).collect()  # six kinds at most
    if len(found) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields: members named by data are no schema")
    return {r["field"]: promote(set(r["kinds"])) for r in sorted(found, key=lambda r: r["field"])}


def union_columns(fields: list[str], taken: list[str]) -> dict[str, str]:
    """Field -> column: names that are equal but for case are numbered, in order of code points."""
    used = {t.lower() for t in taken}
    out = {}
    for f in sorted(fields):
        name, n = f, 1
        while name.lower() in used:
            n += 1
            name = f"{f}__{n}"
        used.add(name.lower())
        out[f] = name
    return out


def union_table(df: DataFrame, key: str, body: str, group: str = "rules") -> DataFrame:
    """One row per member of the group (position -1: a file without any), cast to the union schema.

    Columns are the fields' dotted paths; the pack's own fields repeat on each of its rows.
    """
    schema = union_schema(df, body, group)
    columns = union_columns(list(schema), [key, f"{group}_pos"])
    kind = dict(df.dtypes)[key]

    def read(batches):
        for batch in batches:
            ks, at, pos, vals = batch.column(0), [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = read_object(text, group)
                if got is None:
                    continue
                own, members = got
                for p, m in enumerate(members) if members else [(-1, [])]:
                    at.append(i)
                    pos.append(p)
                    vals.append([(k, json.dumps(v, ensure_ascii=False) if not isinstance(v, str) else v) for k, v in {**dict(own), **dict(m)}.items()])
            yield pa.RecordBatch.from_arrays(
                [ks.take(pa.array(at, pa.int64())), pa.array(pos, pa.int64()), pa.array(vals, pa.map_(pa.string(), pa.string()))],
                names=["k", "pos", "vals"],
            )

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{body}`").alias("body")).mapInArrow(
        read, f"k {kind}, pos bigint, vals map<string,string>"
    )
    cols = []
    for name, to in schema.items():
        v = F.col("vals")[name]
        if to == "array<string>":
            # a scalar becomes a list of one
            c = F.when(v.isNotNull(), F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")), F.array(v)))
        elif to == "string":
            c = v
        else:
            c = v.try_cast(to)
        cols.append(c.alias(columns[name]))
    return rows.select(F.col("k").alias(key), F.col("pos").alias(f"{group}_pos"), *cols)
