"""Copy differences, nested records and drifting schemas against brute force and by hand."""

import json
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.functions.jsonstream import NotJson, triples
from codelode.operators import copydiff, drift, nested
from codelode.plans import data_problems

T0 = datetime(2025, 1, 1)
COPY = "id string, revised_at timestamp, v string, n int, flag boolean, k string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- copies


def brute_diff(left, right):
    def current(rows):
        best = {}
        for r in rows:
            if r[0] is not None and (r[0] not in best or (r[1] or datetime.min) > (best[r[0]][1] or datetime.min)):
                best[r[0]] = r
        return best

    a, b, out = current(left), current(right), []
    for k in a.keys() | b.keys():
        if k not in b:
            out.append((k, "id", "missing_in_r"))
        elif k not in a:
            out.append((k, "id", "missing_in_l"))
        else:
            out += [(k, c, "differs") for i, c in ((2, "v"), (3, "n"), (4, "flag")) if a[k][i] != b[k][i]]
    return sorted(out)


@pytest.mark.parametrize("buckets", [1, 4, None])
def test_diff_against_brute_force(spark, buckets):
    left, right = [], []
    for i in range(300):
        row = (f"r{i}", T0 + timedelta(days=i % 5), f"text {i}", i, i % 2 == 0, "x")
        if i % 40 != 1:
            left.append(row)
        if i % 40 != 2:
            right.append((row[0], row[1], None if i % 50 == 3 else row[2] + "!" * (i % 60 == 4), row[3] + (i % 70 == 5), row[4], "y"))
        if i % 30 == 6:  # an older revision and an undated one say otherwise
            left += [(row[0], None, "old", 0, None, ""), (row[0], T0 - timedelta(days=9), None, None, None, "")]
        if i % 30 == 7:
            right += [right[-1]] * 3
    right += [(None, T0, "no id", 1, True, "")]
    left += [("hot", T0, "h", 1, None, "")] * 200
    found = copydiff.diff_copies(
        spark.createDataFrame(left, COPY), spark.createDataFrame(right, COPY), "id", ["v", "n", "flag"], "revised_at", "l", "r", buckets
    )
    assert rows_of(found) == brute_diff(left, right)


def test_diff_of_empty_and_equal_copies(spark):
    empty = spark.createDataFrame([], COPY)
    one = spark.createDataFrame([("a", None, None, None, None, "")], COPY)
    args = ("id", ["v", "n", "flag"], "revised_at", "l", "r")
    assert rows_of(copydiff.diff_copies(empty, empty, *args)) == []
    assert rows_of(copydiff.diff_copies(one, one, *args)) == []
    assert rows_of(copydiff.diff_copies(one, empty, *args)) == [("a", "id", "missing_in_r")]


def test_only_unequal_cells_are_marked(spark):
    a = spark.createDataFrame([(f"{i}", T0, "x", i, True, "") for i in range(100)], COPY)
    b = spark.createDataFrame([(f"{i}", T0, "x", i + (i == 50), True, "") for i in range(100)], COPY)
    cells = copydiff.checksum_matrix(a, b, "id", ["v", "n", "flag"], "revised_at", 16).collect()
    assert [r.unequal for r in cells] == [[False, False, True, False]]


# --- nested records

JSON = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(codec="utf-8")),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4),
    max_leaves=20,
)


def loaded(o, path=(), ords=()):
    if isinstance(o, dict):
        yield path, ords, "object", None
        for k, v in o.items():
            yield from loaded(v, (*path, k), ords)
    elif isinstance(o, list):
        yield path, ords, "array", None
        for i, v in enumerate(o):
            yield from loaded(v, (*path, "[]"), (*ords, i))
    else:
        kind = {str: "string", bool: "boolean", type(None): "null"}.get(type(o), "number")
        yield path, ords, kind, o


@given(JSON, st.sampled_from([None, 1]))
@settings(max_examples=150, deadline=None)
def test_triples_are_those_of_a_whole_parse(o, indent):
    got, want = list(triples(json.dumps(o, indent=indent))), list(loaded(o))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(a[3] == b[3] for a, b in zip(got, want, strict=True))


@given(st.text(alphabet='{}[]:,"a1 tru\\', max_size=12))
@settings(max_examples=300, deadline=None)
def test_triples_accept_what_json_accepts(text):
    try:
        json.loads(text)
        good = True
    except ValueError:
        good = False
    try:
        list(triples(text))
        assert good
    except NotJson:
        assert not good


def test_triples_of_deep_text():
    assert sum(1 for _ in triples("[" * 50_000 + "]" * 50_000)) == 50_000
    with pytest.raises(NotJson):
        list(triples("[" * 50_000))


def brute_patterns(key, body):
    try:
        o = json.loads(body.removeprefix("﻿"))
    except (ValueError, AttributeError):
        return
    if isinstance(o, dict):
        o = o.get("packs", o.get("pack", o))
    many = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    for p, pack in enumerate(many(o)):
        for r, rule in enumerate(many((pack or {}).get("rules"))):
            m = (rule or {}).get("matcher")
            if isinstance(m, str):
                m = json.loads(m)
            for name in ("patterns", "absent"):
                for i, item in enumerate(many((m or {}).get(name))):
                    if isinstance(item, str) or (item and item.get("pattern") is not None):
                        yield key, p, r, rule["id"], name, i


def test_patterns_of_the_whole_table(spark, sf):
    pdf = pd.read_parquet(f"{sf}/sql_packs.parquet")
    want = sorted({x for k, b in zip(pdf.pack_key, pdf.body, strict=True) for x in brute_patterns(k, b)})
    assert want and rows_of(data_problems.p5_found(spark, sf)) == want


def test_nested_odd_bodies(spark):
    bodies = [
        None, "", "{", "null", "[]", "3", '{"rules": {"id": "a", "matcher": {"patterns": "x"}}}',
        '{"pack": {"rules": [null, {"id": "b", "matcher": "{\\"absent\\": [null, {\\"pattern\\": null}, {\\"pattern\\": \\"y\\"}]}"}]}}',
        '{"packs": {"rules": [{"matcher": "no json", "id": "c"}, {"id": "d", "id": "e", "matcher": {"patterns": ["p"], "patterns": ["q", "r"]}}]}}',
        '[{"rules": []}, {"rules": [{"matcher": {"patterns": [{"pattern": "z"}]}, "id": "f"}]}]',
    ]
    df = spark.createDataFrame([(i, b, "clash", "clash") for i, b in enumerate(bodies)], "pack_key long, body string, grp string, key string")
    got = rows_of(nested.pattern_table(nested.rule_pack_groups(df)).select("pack_key", "pack_pos", "rule_pos", "rule_id", "list_name", "item_pos", "pattern"))
    assert got == [
        (6, 0, 0, "a", "patterns", 0, "x"),
        (7, 0, 1, "b", "absent", 2, "y"),
        (8, 0, 1, "e", "patterns", 0, "q"),
        (8, 0, 1, "e", "patterns", 1, "r"),
        (9, 1, 0, "f", "patterns", 0, "z"),
    ]
    assert nested.rule_pack_groups(df.limit(0)).count() == 0


# --- drift


def brute_changes(pdf):
    def flat(o, at=""):
        for k, v in o.items():
            if isinstance(v, dict):
                yield from flat(v, f"{at}{k}.")
            elif v is not None:
                yield at + k, v

    kind = lambda v: {str: "s", bool: "b", list: "a"}.get(type(v), "n")
    out = set()
    for _, g in pdf.sort_values(["written_at", "file_key"]).groupby(["source", "path"]):
        last = None
        for key, body in zip(g.file_key, g.body, strict=True):
            o, now = json.loads(body), defaultdict(dict)
            for k, v in flat({k: v for k, v in o.items() if k != "rules"}):
                now[k][None] = v
            for r in o["rules"]:
                for k, v in flat(r, "rules."):
                    now[k][r["id"]] = v
            if last is not None:
                ids = {i for f in last.values() for i in f} & {i for f in now.values() for i in f}
                gone, come = last.keys() - now.keys(), now.keys() - last.keys()
                cut = lambda f: {i: (v, kind(v)) for i, v in f.items() if i in ids}  # noqa: B023, E731
                pairs = {(a, b) for a in gone for b in come if cut(last[a]) and cut(last[a]) == cut(now[b])}
                out |= {(key, "renamed", a, b) for a, b in pairs}
                out |= {(key, "removed", a, "") for a in gone - {a for a, _ in pairs}}
                out |= {(key, "added", b, "") for b in come - {b for _, b in pairs}}
                for f in last.keys() & now.keys():
                    if {kind(v) for v in last[f].values()} != {kind(v) for v in now[f].values()}:
                        out.add((key, "type_changed", f, ""))
            last = now
    return sorted(out)


def test_changes_of_the_whole_table(spark, sf):
    want = brute_changes(pd.read_parquet(f"{sf}/pack_files.parquet"))
    assert want and rows_of(data_problems.p6_found(spark, sf)) == want


def pack(*rules, **own):
    return json.dumps({"id": "http", **own, "rules": list(rules)})


def test_changes_by_hand(spark):
    a, b = {"id": "a", "axis": "x", "m": {"kind": 1}}, {"id": "b", "axis": "y", "m": {"kind": 2}}
    versions = [
        pack(a, b, schema_version=1),
        pack({**a, "axis": None, "role": "x"}, {"id": "b", "role": "y", "m": {"kind": 2}}, schema_version="1"),  # renamed, type changed
        pack({"id": "a", "role": "x", "m": {"kind": [1]}}, schema_version="1", runtime=None),  # a rule left; its type differs
        pack({"id": "a", "lane": "z", "m": {"kind": [1]}}, schema_version="1"),  # other values: removed and added
        pack({"id": "a", "lane": "z", "m": {"kind": [1]}}, schema_version="1"),
        None, "no json", "[1]",
        pack({"id": "a", "m": {"kind": [1]}}, schema_version="1", lane2="z"),
    ]
    rows = [(i, "s", "p", T0 + timedelta(hours=9 * i), v, "clash", "clash") for i, v in enumerate(versions)]
    df = spark.createDataFrame(rows + rows[:2], "file_key long, source string, path string, written_at timestamp, body string, k string, header string")
    args = ("file_key", ["source", "path"], "written_at", "body")
    assert rows_of(drift.schema_changes(df, *args)) == [
        (1, "renamed", "rules.axis", "rules.role"),
        (1, "type_changed", "schema_version", ""),
        (2, "type_changed", "rules.m.kind", ""),
        (3, "added", "rules.lane", ""),
        (3, "removed", "rules.role", ""),
        (8, "added", "lane2", ""),
        (8, "removed", "rules.lane", ""),
    ]
    assert rows_of(drift.schema_changes(df.limit(0), *args)) == []
    assert drift.union_schema(df, "body")["rules.m.kind"] == "array<string>"
    table = {(r.file_key, r.rules_pos): r for r in drift.union_table(df, "file_key", "body").distinct().collect()}
    assert table[0, 1]["rules.m.kind"] == ["2"] and table[0, 0]["schema_version"] == "1" and table[1, 0]["rules.axis"] is None


def test_versions_without_times(spark):
    rows = [(i, None, "p", None, pack({"id": "a", f"f{i}": i}), ) for i in range(4)]
    df = spark.createDataFrame(rows, "file_key long, source string, path string, written_at timestamp, body string")
    got = rows_of(drift.schema_changes(df, "file_key", ["source", "path"], "written_at", "body"))
    assert [x[0] for x in got] == [1, 1, 2, 2, 3, 3]


def test_a_file_that_spans_many_tasks(spark):
    rows = []
    for i in range(400):
        body = {"a": 1, "rules": [{"id": "x", ("p" if i % 7 < 3 else "q"): i % 5}]}
        rows.append((i, "s", "one" if i % 3 else "two", T0 + timedelta(minutes=i), json.dumps(body)))
    df = spark.createDataFrame(rows, "file_key long, source string, path string, written_at timestamp, body string")
    want, last = [], {}
    for k, _, path, _, body in rows:
        v = drift.Version.read(body, "rules", "id")
        if path in last:
            want += [(k, *x) for x in drift.changes(last[path], v)]
        last[path] = v
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert rows_of(drift.schema_changes(df, "file_key", ["source", "path"], "written_at", "body")) == sorted(want)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_union_of_names_that_differ_in_case_and_of_long_integers(spark):
    bodies = [
        {"n": 2**60, "m": 1, "x": 2**70, "rules": [{"id": "a", "matcher": {"Kind": "K", "kind": "k"}, "FILE_KEY": "f"}]},
        {"n": 3, "m": 0.5, "rules": [{"id": "b", "matcher": {"KIND": True}}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "file_key long, body string")
    got = drift.union_table(df, "file_key", "body")
    assert {c: t for c, t in got.dtypes if c != "file_key"} == {
        "rules_pos": "bigint", "m": "double", "n": "bigint", "x": "string", "rules.FILE_KEY": "string", "rules.id": "string",
        "rules.matcher.KIND": "boolean", "rules.matcher.Kind__2": "string", "rules.matcher.kind__3": "string",
    }
    one, two = (r.asDict() for r in got.orderBy("file_key").collect())
    assert one["n"] == 2**60 and one["x"] == str(2**70) and one["rules.matcher.Kind__2"] == "K" and one["rules.matcher.kind__3"] == "k" and two["rules.matcher.KIND"] is True and two["m"] == 0.5
    assert drift.union_columns(["file_KEY", "a"], ["file_key"]) == {"a": "a", "file_KEY": "file_KEY__2"}
