"""The link's laws, history, graph, rules, findings, sources and composition on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from codelode.operators import compose, crossrules, findings, graph, history, link, nearmiss, routes, rules, scores
from codelode.plans.bindings import HOSTS, relation
from codelode.sources import code, envelope, gitlog
from codelode.streaming import incremental

P = "source string, kind string, key string, file string, line int, symbol string"
C = "id int, source string, kind string, key string, file string, line int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sides(spark):
    provides = [
        ("be", "http", "GET /a", "s.ts", 1, "h"), ("be", "http", "GET /a", "s.ts", 9, "h2"), ("be", "http", "GET /two", "s.ts", 2, "h"), ("be2", "http", "GET /two", "t.ts", 3, "h"),
        ("be", "http", "GET /files/**", "w.ts", 4, "h"), ("be", "http", "GET /dead", "s.ts", 5, "h"), ("db", "db-table", "users", "m.sql", 6, None), ("be", "http", "GET /api/v1/items/{}", "s.ts", 7, "h"),
    ]
    consumes = [
        (1, "fe", "http", "GET /a", "u.ts", 1), (2, "fe", "http", None, "u.ts", 2), (3, "fe", "http", "GET https://vendor.com/x", "u.ts", 3), (4, "fe", "http", "GET /two", "u.ts", 4),
        (5, "fe", "http", "GET /files/x/y", "u.ts", 5), (6, "fe", "http", "GET /{}/{}", "u.ts", 6), (7, "fe", "http", "GET /nope", "u.ts", 7), (8, "fe", "db-table", "users", "u.ts", 8),
        (9, "fe", "http", "GET http://Internal.example:8443/a?x=1", "u.ts", 9), (10, "fe", "http", "GET ws://internal.example/a", "u.ts", 10), (11, "fe", "http", "POST /a", "u.ts", 11),
        (12, "fe", "http", "GET /A", "u.ts", 12), (13, "fe", "http", "GET /api/v2/items/{}", "u.ts", 13), (14, "fe", "http", "GET /v1/items/{}", "u.ts", 14), (15, "fe", "http", "GET /api/v1/items/7", "u.ts", 15),
        (16, "fe", "http", "GET /files", "u.ts", 16), (17, "fe", "http", "POST /files/x", "u.ts", 17),
    ]
    p, c = spark.createDataFrame(provides, P), spark.createDataFrame(consumes, C)
    return p, c, link.classify(c, p, HOSTS)


def test_buckets(sides):
    _, _, c = sides
    assert {r.id: r.bucket for r in c.collect()} == {
        1: "edge", 2: "unresolved", 3: "external", 4: "ambiguous", 5: "wildcard", 6: "unresolved", 7: "unprovided", 8: "edge", 9: "edge", 10: "external", 11: "unprovided", 12: "unprovided",
        13: "unprovided", 14: "unprovided", 15: "unprovided", 16: "wildcard", 17: "unprovided",
    }


def test_edges_and_leftovers(sides):
    p, _, c = sides
    e = link.edges(c, p, [(r"^GET /a$", "short")]).collect()
    assert sorted((r.from_line, r.to_line, r.low_confidence_reason) for r in e) == [(1, 1, "short"), (1, 9, "short"), (8, 6, None), (9, 1, "short"), (9, 9, "short")]
    assert [r.key for r in link.unconsumed(c, p).orderBy("key").collect()] == ["GET /api/v1/items/{}", "GET /dead"]
    assert rows(link.host_rekeys(c)) == [("internal.example", 1)] and link.wildcard_partitions(c, p).first().covered == 2
    assert link.ambiguous(c, p).first().shown == "be2:t.ts:3,be:s.ts:2"


def test_near_misses(sides):
    p, _, c = sides
    m = c.where("bucket = 'unprovided'")
    assert rows(nearmiss.method_mismatch(m, p).select("id", "provide_key")) == [(11, "GET /a")]
    assert rows(nearmiss.version_skew(m, p).select("id", "provide_key")) == [(13, "GET /api/v1/items/{}")]
    assert rows(nearmiss.route_near_miss(m, p).select("id", "how")) == [(12, "case"), (14, "prefix")]
    assert (15, "GET /api/v1/items/{}") in rows(nearmiss.path_near_miss(m, p).select("id", "provide_key"))


def test_every_consume_has_one_bucket_in_any_order(spark, sf):
    c, p = relation(spark, sf, "consumes"), relation(spark, sf, "provides")
    one = link.classify(c, p, HOSTS).select("id", "bucket")
    other = link.classify(c.repartition(7).orderBy(F.rand(3)), p.repartition(5), HOSTS).select("id", "bucket")
    assert one.count() == c.count() and one.exceptAll(other).isEmpty()


def test_shadowing_and_caps(spark):
    p = spark.createDataFrame([("s", "http", "GET /a/{}", "f", 1, ""), ("s", "http", "GET /a/b", "f", 5, ""), ("s", "http", "GET /c/d", "f", 9, ""), ("s", "http", "GET /{}/{}", "f", 2, "")], P)
    assert rows(routes.shadowed_in_file(p).select("key", "by_line")) == [("GET /a/b", 1)]
    assert [r.folded for r in routes.capped(p, "source", ["line"], 3).collect()] == [1, 1, 1]


def test_coupling_rules(spark):
    big = [("big", f"f{i}") for i in range(26)]
    data = [(s, None, "x", f, 1, 1, None) for s, f in [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("3", "c"), ("4", "a"), *big]]
    df = spark.createDataFrame(data, "sha string, ts timestamp, author string, path string, added long, deleted long, tag string")
    assert rows(history.coupling(df).select("a", "b", "n")) == [("a", "b", 2), ("a", "c", 1), ("b", "a", 2), ("c", "a", 1)]
    assert rows(history.cochange_edges(history.coupling(df, 1))) == [("a", "b", 2), ("a", "c", 1)]
    assert history.coupling(df.limit(0)).isEmpty()


def test_scc_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(38)]
    reach = {i: {i} for i in range(30)}
    for _ in range(30):
        for a, b in edges:
            reach[a] |= reach[b]
    on_cycle = {i for i in range(30) if (i, i) in edges or any(j != i and i in reach[j] and j in reach[i] for j in range(30))}
    want = sorted((i, min(j for j in range(30) if j in reach[i] and i in reach[j])) for i in on_cycle)
    df = spark.createDataFrame(edges, "src int, dst int")
    assert sorted(tuple(r) for r in graph.scc(df).collect()) == want
    start = spark.createDataFrame([(edges[0][0],)], "node int")
    assert {r.node for r in graph.reachable(df, start).collect()} == reach[edges[0][0]]
    assert graph.scc(df.limit(0)).isEmpty()


def test_diamonds_and_seams(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "l"), ("b", "l"), ("r", "x"), ("x", "y")], "src string, dst string")
    assert rows(graph.diamonds(e)) == [("r", "l", 2)]
    assert graph.diamonds(e.union(spark.createDataFrame([("r", "l")], e.schema))).isEmpty()


def test_scores_of_nothing(spark):
    e, f = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "path string, loc long")
    s = scores.all_scores(e, f, 0).collect()
    assert all(r.population == 0 and r.score == 100 for r in s) and scores.health(scores.all_scores(e, f, 0)).first().pain is None


def test_rules(spark):
    text = 'const token = "correct-horse-battery-staple";\n// danger(1)\ndanger(2); // danger-ok\n\ndanger(3);\nfunction f() {\n  open();\n  close();\n}\nfunction g() {\n  close();\n  open();\n}\n'
    f = spark.createDataFrame([("s", "a/b.ts", text), ("s", "a/b.py", "# danger()\ndanger()\n"), ("s", "e.ts", ""), ("s", "n.ts", None)], "source string, path string, text string")
    rule = {"id": "danger", "line_pattern": r"danger\(", "skip_comment_lines": True, "marker": "danger-ok"}
    assert rows(rules.line_scan(f, [rule]).select("path", "line")) == [("a/b.py", 2), ("a/b.ts", 5)]
    pair = {"id": "pair", "patterns": [r"open\(", r"close\("], "ordered": True, "file_pattern": r"\.ts$"}
    assert rows(rules.method_scan(f, [pair]).select("start", "line")) == [(6, 8)]
    hit = rules.literal_scan(rules.literals(f), "(?i)token", None, 80.0).first()
    assert hit.name == "token" and hit.entropy > 97 and not any("horse" in str(x) for x in hit)
    shape = {r.path: (r.loc, r.minified) for r in rules.shape(f).collect()}
    assert shape["a/b.ts"] == (13, False) and shape["e.ts"] == (0, False)
    assert rules.expand_fragments({"line_pattern": "x${n}"}, {"n": "y+"}) == {"line_pattern": "xy+"}
    io = spark.createDataFrame([(None, "http"), ("GET /a", "http")], "key string, kind string")
    assert rows(rules.io_scan(io, "^GET", True).select("key")) == [(None,)]


def test_longest_prefix_wins(spark):
    a = spark.createDataFrame([("x", "1"), ("x/y", "2"), ("x/y/z.ts", "3")], "scope string, value string")
    f = spark.createDataFrame([("x/y/z.ts",), ("x/y/w.ts",), ("x/q",), ("xy/z",)], "path string")
    assert rows(rules.longest_prefix(f, "path", a)) == [("x/q", "1"), ("x/y/w.ts", "2"), ("x/y/z.ts", "3"), ("xy/z", None)]


def test_findings(spark):
    data = [(1, "s", "r/a", "CRITICAL ", "a.ts", 3, "2025-01-02"), (1, "s", "r/a", "CRITICAL ", "a.ts", 3, "2025-01-01"), (2, "s", "r/b", "info", None, -1, None), (3, "t", "r/a", None, "core/x.ts", 1, None)]
    df = spark.createDataFrame(data, "finding_id long, source string, rule_id string, severity string, file string, line int, ingested_at string")
    now = findings.normalised(findings.current(df), {"r/b": "warning"})
    assert rows(now.select("finding_id", "severity", "severity_rank", "line", "ingests")) == [(1, "critical", 0, 3, 2), (2, "warning", 1, None, 1), (3, None, 3, 1, 1)]
    assert [r.finding_id for r in findings.top(now, "warning", 10).collect()] == [1, 2]
    assert findings.suppressed(now, ["core/**"]).count() == 2
    assert rows(findings.compare(now.where("finding_id < 3"), now.where("finding_id > 1"), ["finding_id"])) == [(1, "removed"), (3, "added")]
    assert rows(findings.blind_sources(now, now.where("source = 's'"))) == [("t",)]


def test_git_log(spark):
    log = "\x1fabc\x1f2025-01-02T03:04:05+00:00\x1fann\x1ffix(ui): it\n3\t1\tsrc/{old => new}/f.ts\n-\t-\tpic.png\n2\t0\ta => b\n\x1fdef\x1fbad date\x1fbob\x1f[docs] x\n1\t1\tsrc/g.ts\nnoise"
    got = gitlog.commit_files(spark.createDataFrame([(log,), (None,), ("",)], "t string"), "t")
    assert rows(got.select("sha", "path", "old_path", "added", "tags")) == [("abc", "b", "a", 2, ["FIX"]), ("abc", "src/new/f.ts", "src/old/f.ts", 3, ["FIX"]), ("def", "src/g.ts", None, 1, ["DOCS"])]
    assert rows(gitlog.rebase(got, "src").select("path")) == [("g.ts",), ("new/f.ts",)] and got.where("sha = 'def'").first().ts is None


def test_envelopes(spark):
    good = '{"format": "normalized-facts", "version": "1.29", "parser": "p", "source": "s", "files": [{"path": "a", "loc": 3, "io": {"provides": [{"kind": "http", "key": "GET /x", "line": 2}]}}]}'
    bad = '{"format": "other", "version": "9.0.1", "files": [{"path": ""}, {"path": ""}]}'
    parsed = envelope.parse(spark.createDataFrame([(1, good), (2, bad), (3, "no"), (4, None)], "k int, t string"), "k", "t")
    assert rows(envelope.issues(parsed)) == [(2, "duplicate-path"), (2, "empty-path"), (2, "newer-version"), (2, "wrong-format"), (3, "unreadable"), (4, "unreadable")]
    assert rows(envelope.provides(parsed).select("file", "key")) == [("a", "GET /x")]
    page = """{"format": "elsewhere", "version": "0.29.0", "parser": "lexical/1", "source": "old", "files": [{"path": "web/u.jsp", "loc": 86, "symbols": [
      {"id": "web/u.jsp#get", "file": "web/u.jsp", "name": "get", "kind": "function", "line": 12, "exported": true, "bodyStart": 12, "bodyEnd": 20}],
      "imports": {"db": {"specifier": "./db", "original": "*"}}, "re_exports": [{"specifier": "./x", "original": "a", "local_alias": "b"}], "used_names": ["get"],
      "calls": [{"from_symbol": "web/u.jsp#get", "callee_name": "render", "line": 15}], "degraded": false,
      "io": {"provides": [{"kind": "http", "key": "GET /u", "file": "web/u.jsp", "line": 12, "response": {"fields": [{"name": "email", "optional": true}], "complete": true}}],
             "consumes": [{"kind": "db-table", "key": "table:users", "line": 18, "raw": null}]}}]}"""
    real = envelope.parse(spark.createDataFrame([(1, page), (2, page.replace("0.29.0", "0.30")), (3, page.replace("0.29.0", "x.1"))], "k int, t string"), "k", "t")
    assert rows(envelope.issues(real, ("elsewhere",), "0.29.0")) == [(2, "newer-version"), (3, "malformed-version")]
    one = real.where("k = 1")
    assert rows(envelope.symbols(one).select("name", "body_start", "body_end")) == [("get", 12, 20)] and rows(envelope.imports(one).select("local", "specifier")) == [("db", "./db")]
    assert rows(envelope.re_exports(one).select("local_alias")) == [("b",)] and rows(envelope.calls(one).select("callee_name", "line")) == [("render", 15)]
    assert rows(envelope.response_fields(one)) == [("old", "GET /u", "email", True)] and rows(envelope.consumes(one).select("key")) == [("table:users",)]


def test_lexical_readers(spark):
    sql = "-- x\nCREATE TABLE IF NOT EXISTS Users (a int);\nCREATE TEMP TABLE t (a int);\nINSERT INTO users VALUES ('a;b');\nSELECT * FROM users JOIN orders o ON 1=1;"
    st = code.sql_statements(spark.createDataFrame([("s", "a.sql", sql)], "source string, path string, text string"))
    assert st.count() == 4 and rows(code.sql_provides(st).select("table_name")) == [("users",)]
    assert {r.table_name for r in code.sql_tables(st).collect()} == {"users", "t", "orders"}
    prisma = "model A {\n  id Int @id\n  price Float\n  updatedAt DateTime\n  doneAt String?\n  tags String[]\n}\n"
    fields = code.prisma_models(spark.createDataFrame([("s", "x.prisma", prisma)], "source string, path string, text string"))
    assert fields.count() == 5 and {r.issue for r in code.model_issues(fields).collect()} == {"missing-timestamps", "float-money", "stale-updated-at", "temporal-string"}
    paths = spark.createDataFrame([("pages/users/[id].tsx",), ("app/(g)/shop/page.tsx",), ("lib/x.ts",)], "p string")
    assert [r.x for r in paths.select(code.convention_route(F.col("p")).alias("x")).collect()] == ["/users/{}", "/shop", None]
    facts = list(code.python_facts("import os as o\n@app.get('/x/{id}')\ndef f():\n    g(1)\nclass K: pass\n"))
    assert ("route", "f", 2, 2, "GET /x/{id}") in facts and ("import", "o", 1, 1, "os") in facts and list(code.python_facts("def (")) == []


def test_composition(spark):
    routes_ = spark.createDataFrame([("users", "GET /{}"), ("api", "GET /ping")], "router string, key string")
    mounts = spark.createDataFrame([("app", "api", "/api/"), ("api", "users", "users"), ("users", "api", "loop")], "parent string, child string, prefix string")
    got = compose.router_mounts(routes_, mounts, spark.createDataFrame([("app",)], "router string"))
    assert rows(got) == [("api", "GET /api/ping"), ("users", "GET /api/users/{}")]
    p = spark.createDataFrame([("s", "http", "GET /a", "x/y/z.ts")], "source string, kind string, key string, file string")
    m = spark.createDataFrame([("s", "x", "/one"), ("s", "x/y", "/two")], "source string, dir string, prefix string")
    assert compose.config_mounts(p, m).first().key == "GET /two/a"
    one = spark.createDataFrame([("s", "/v1")], "source string, prefix string")
    assert compose.global_prefix(p, one).first().key == "GET /v1/a" and compose.global_prefix(p, one.union(spark.createDataFrame([("s", "/v2")], one.schema))).first().key == "GET /a"
    d = compose.shapes(spark.createDataFrame([("1", "A", "x", False), ("1", "A", "y", True), ("2", "B", "x", False), ("3", "B", "z", False)], "decl string, name string, field string, optional boolean"))
    e = spark.createDataFrame([("k", ["y", "w"], True, "A"), ("k2", ["x"], True, "B")], "key string, body_keys array<string>, complete boolean, dto_ref string")
    assert rows(compose.body_drift(e, d)) == [("k", ["x"], ["w"])]


def test_incremental_store_and_feed(spark, tmp_path):
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string")
    files.write.parquet(str(tmp_path / "in"))
    seen = []
    run = lambda: incremental.run_incremental(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"), "1", lambda df: seen.append(df.count())).awaitTermination(120)
    run()
    spark.createDataFrame([("a", "x"), ("b", "changed")], files.schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert seen == [2, 1]


def test_cross_rules(spark):
    p = spark.createDataFrame([("a", "http", "GET /x/y", "f", 1, ""), ("b", "http", "GET /x/{}", "f", 1, ""), ("a", "http", "GET /x/{}", "f", 2, ""), ("b", "http", "GET /{}/{}", "f", 3, "")], P)
    assert rows(crossrules.shadowed_across(p)) == [("a", "GET /x/y", "b", "GET /x/{}")]
    r = spark.createDataFrame([("s", "k", "user_password"), ("s", "k", "Pin"), ("s", "k2", "refresh-token"), ("s", "k2", "tokenCount"), ("s", "k2", "contentHash"), ("s", "k", "hash"), ("s", "k2", "API_KEY")], "source string, key string, field string")
    assert rows(crossrules.sensitive_fields(r, spark.createDataFrame([("k",)], "key string"))) == [("s", "k", "hash", True), ("s", "k", "user_password", True), ("s", "k2", "API_KEY", False), ("s", "k2", "refresh-token", False)]
    e = spark.createDataFrame([("POST /a", True), ("POST /b", True), ("GET /c", True), ("PUT /d", False)], "key string, retry_configured boolean")
    assert rows(crossrules.retried_writes(e, spark.createDataFrame([("POST /b",)], "key string"))) == [("POST /a", True)]
    m = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "3"), ("t", "1")], "source string, path string")
    assert rows(crossrules.silent_sources(m, m.where("source = 't'"))) == [("s", 3)]


def test_recommendations_and_critical_files(spark):
    from codelode.operators import advice

    n = "path string, change_count long, churn long, loc long, fan_in long, fan_out long, author_count long, risk double, lifecycle string"
    nodes = spark.createDataFrame(
        [("a.ts", 9, 900, 50, 10, 3, 2, 100.0, "Volatile"), ("index.ts", 1, 1, 400, 0, 20, 1, 1.0, "Stable"), ("fat.ts", 1, 1, 100, 0, 8, 1, 1.0, "Stable"), ("barrel.ts", 1, 1, 16, 0, 8, 7, 1.0, "Stable"), ("tiny.ts", 0, 0, 1, 0, 0, 0, 100.0, "Stable")], n
    )
    fixes = spark.createDataFrame([("a.ts", 5)], "path string, n long")
    pairs = spark.createDataFrame([("a.ts", "fat.ts", 10), ("a.ts", "tiny.ts", 12), ("fat.ts", "tiny.ts", 9), ("tiny.ts", "a.ts", 12)], "a string, b string, n long")
    edges = spark.createDataFrame([("tiny.ts", "a.ts")], "src string, dst string")
    cycles = spark.createDataFrame([(3, "a.ts"), (2, "tiny.ts")], "size long, first string")
    got = {(r.rule, r.path): (r.measure, r.roi) for r in advice.recommendations(nodes, fixes, pairs, edges, cycles).collect()}
    assert got == {
        ("bug-prone", "a.ts"): (5.0, 2.625), ("hot-churn", "a.ts"): (18.0, 1.25), ("fat-fanout", "fat.ts"): (8.0, 0.014), ("knowledge-silo", "barrel.ts"): (7.0, 0.01875),
        ("versioning-candidate", "a.ts"): (5.0, 1.25), ("hidden-coupling", "a.ts"): (10.0, 1.25), ("circular", "a.ts"): (3.0, 2.625), ("circular", "tiny.ts"): (2.0, 21.0),
    }
    chain = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(5)] + [("f5", "f3")], "src string, dst string")
    from codelode.operators import graph

    d = graph.dependents(chain)
    assert {r.node: r.dependents for r in d.collect()} == {"f1": 1, "f2": 2, "f3": 5, "f4": 5, "f5": 5}
    own = spark.createDataFrame([("f3", 1, 9, 10, 1), ("f4", 3, 9, 10, 1), ("f5", 2, 9, 5000, 1), ("f2", 1, 1, 1, 1)], "path string, change_count long, fan_in long, loc long, author_count long")
    assert [(r.path, r.blast_radius, r.silent) for r in advice.critical_files(own, d).collect()] == [("f5", 5, True), ("f3", 5, True), ("f4", 5, False)]
