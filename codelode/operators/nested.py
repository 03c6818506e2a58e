"""Flat tables out of nested JSON records, with parent-child links.

Each record is stream-parsed into path-value-ordinal triples. Triples are
grouped by their nearest repeated ancestor (the last array on their path) and
each group is pivoted into rows: one row per ordinal of the group, one entry per
path below it. All of that happens beside the record, so no row is shuffled; the
tables are then plain projections of one exploded frame.

Defined results
* Null, empty and unreadable bodies give no row; so do bodies cut off half-way.
* A byte-order mark before the text is ignored.
* Null members of a list keep their position but give a row without entries.
* A lone member where a list is declared is item 0; an undeclared lone object
  belongs to its parent.
* Of members named alike in one object the last counts.
* Declared JSON text (`as_json`) is read as if it stood there unquoted; text that
  is no JSON stays a string.
* Repeated rows give repeated results. Columns other than the key and the body
  are not read, so their names can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.jsonstream import NotJson, triples


@dataclass(frozen=True)
class Layout:
    """What a body may look like.

    root: name given to the outermost object; it always counts as a list.
    wrappers: members that may wrap the root, alone or in a list.
    lists: member names that are lists even where a lone member stands.
    as_json: member names whose text may be JSON.
    """

    root: str
    wrappers: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    as_json: tuple[str, ...] = ()


def _expanded(text: str, layout: Layout) -> Iterator[tuple]:
    """Triples with declared JSON text read in place."""
    for path, ords, kind, value in triples(text):
        if kind == "string" and path and path[-1] in layout.as_json:
            try:
                inner = list(triples(value))
            except NotJson:
                inner = []
            if inner and inner[0][2] in ("object", "array"):
                for p, o, k, v in inner:
                    yield path + p, ords + o, k, v
                continue
        yield path, ords, kind, value


def _regular(text: str, layout: Layout) -> Iterator[tuple]:
    """Triples whose every declared list has an ordinal, under the root's list."""
    for path, ords, kind, value in _expanded(text, layout):
        head = 0
        if path[:1] == ("[]",) or (path and path[0] in layout.wrappers):
            head = 1 if path[0] == "[]" or path[1:2] != ("[]",) else 2
        elif kind in ("object", "array") and not path:
            # the outermost container is a record of its own only if it isn't a wrapper;
            # a later triple tells, so its row is made on demand
            continue
        lone = head == 0 or path[head - 1] != "[]"
        out, taken, used = [layout.root, "[]"], [0 if lone else ords[0]], 0 if lone else 1
        rest = path[head:]
        i = 0
        if not rest and kind == "array":
            continue  # the wrapper's own list
        while i < len(rest):
            name = rest[i]
            out.append(name)
            if name == "[]":
                taken.append(ords[used])
                used += 1
            elif name in layout.lists and rest[i + 1 : i + 2] != ("[]",) and not (i + 1 == len(rest) and kind in ("array", "null")):
                out.append("[]")
                taken.append(0)
            i += 1
        yield tuple(out), tuple(taken), kind, value


def pivoted(text: str, layout: Layout) -> list[tuple[str, tuple[int, ...], dict[str, str]]]:
    """(group, ordinals, entries) of one record; entries hold strings as they are, else JSON."""
    groups: dict[tuple, dict[tuple, dict]] = {}
    begun: set = set()
    for path, ords, kind, value in _regular(text, layout):
        if kind in ("object", "array"):
            if (path, ords) in begun:  # a later member of the same name takes its place
                for g, rows in groups.items():
                    if g[: len(path)] == path:
                        for o in [o for o in rows if o[: len(ords)] == ords]:
                            del rows[o]
                begun -= {x for x in begun if x[0][: len(path)] == path and x[1][: len(ords)] == ords}
            begun.add((path, ords))
        cut = len(path) - path[::-1].index("[]")
        rows = groups.setdefault(path[:cut], {})
        entries = rows.setdefault(ords, {})
        if kind in ("string", "number", "boolean"):
            below = ".".join(path[cut:])
            entries[below] = value if kind == "string" else json.dumps(value)
    return [
        (".".join(x for x in g if x != "[]"), ords, entries)
        for g, rows in groups.items()
        for ords, entries in rows.items()
    ]


GROUP_ROW = pa.struct(
    [
        ("grp", pa.string()),
        ("ords", pa.list_(pa.int64())),
        ("entries", pa.map_(pa.string(), pa.string())),
        ("up", pa.map_(pa.string(), pa.string())),
    ]
)


def _read(batches: Iterator[pa.RecordBatch], layout: Layout, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, bodies = batch.column(0), batch.column(1).to_pylist()
        for start in range(0, len(bodies), 256):  # so that one batch of long bodies stays small
            at, rows = [], []
            for i, body in enumerate(bodies[start : start + 256], start):
                if not body:
                    continue
                try:
                    found = pivoted(body, layout)
                except NotJson:
                    continue
                own = {(g, o): e for g, o, e in found}
                for g, o, e in found:
                    up = {}
                    for name in carry:
                        group, _, entry = name.rpartition(":")
                        if g.startswith(group + "."):
                            depth = group.count(".") + 1
                            parent = own.get((group, o[:depth]))
                            if parent and entry in parent:
                                up[name] = parent[entry]
                    at.append(i)
                    rows.append({"grp": g, "ords": list(o), "entries": list(e.items()), "up": list(up.items())})
            if at:
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at, pa.int64())), *pa.array(rows, GROUP_ROW).flatten()],
                    names=["key", "grp", "ords", "entries", "up"],
                )


def nested_groups(df: DataFrame, key: str, body: str, layout: Layout, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, grp, ords, entries, up): one row per member of every repeated ancestor.

    carry names entries of ancestor groups, as `group:entry`, which each row below
    such a group gets in `up`; so a child names its parent without a join.
    """
    kind = dict(df.dtypes)[key]
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{body}`").alias("body")).mapInArrow(
        lambda batches: _read(batches, layout, carry),
        f"key {kind}, grp string, ords array<bigint>, entries map<string,string>, up map<string,string>",
    )


RULE_PACKS = Layout(root="pack", wrappers=("pack", "packs"), lists=("rules", "patterns", "absent"), as_json=("matcher",))


def rule_pack_groups(df: DataFrame, key: str = "pack_key", body: str = "body") -> DataFrame:
    return nested_groups(df, key, body, RULE_PACKS, ("pack.rules:id",))


def pack_table(groups: DataFrame, key: str = "pack_key") -> DataFrame:
    """One row per pack."""
    e = F.col("entries")
    return groups.where(F.col("grp") == "pack").select(
        F.col("key").alias(key), F.get("ords", F.lit(0)).alias("pack_pos"), e["id"].alias("pack_id"),
        e["schema_version"].alias("schema_version"),
    )


def rule_table(groups: DataFrame, key: str = "pack_key") -> DataFrame:
    """One row per rule that is an object with at least one value."""
    e = F.col("entries")
    return groups.where((F.col("grp") == "pack.rules") & (F.size("entries") > 0)).select(
        F.col("key").alias(key), F.get("ords", F.lit(0)).alias("pack_pos"), F.get("ords", F.lit(1)).alias("rule_pos"),
        e["id"].alias("rule_id"), e["axis"].alias("axis"), e["severity"].alias("severity"),
        e["message"].alias("message"), e["matcher.type"].alias("matcher_type"),
        e["matcher.file_pattern"].alias("file_pattern"), e["matcher.trigger"].alias("trigger"),
    )


def pattern_table(groups: DataFrame, key: str = "pack_key") -> DataFrame:
    """One row per member of `patterns` or `absent` that has a pattern."""
    e = F.col("entries")
    return (
        groups.where(F.col("grp").isin("pack.rules.matcher.patterns", "pack.rules.matcher.absent") & (F.size("ords") == 3))
        .select(
            F.col("key").alias(key), F.get("ords", F.lit(0)).alias("pack_pos"), F.get("ords", F.lit(1)).alias("rule_pos"),
            F.col("up")["pack.rules:id"].alias("rule_id"), F.element_at(F.split("grp", "[.]"), -1).alias("list_name"),
            F.get("ords", F.lit(2)).alias("item_pos"), F.coalesce(e["pattern"], e[""]).alias("pattern"), e["label"].alias("label"),
        )
        .where(F.col("pattern").isNotNull())
    )
