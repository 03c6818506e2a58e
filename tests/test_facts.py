"""Facts of small sources by hand, and what follows from them."""

from codelode.sources import facts as X

TS = """import express, { Router as R } from 'express';
import type { Row } from "./types.js";
import * as store from '../data/store';
import './side';
export { one, two as three } from './more';
export * from './all';
const lazy = await import('./lazy');
const { a: b } = require("./old");
// import { no } from './comment';
const text = "import { no } from './string'";
export const LIMIT = 5;
export const handler = async (req: Request) => {
  const inner = 3;
  await fetch(`${BASE}/v1/items/${req.id}?x=1`, { method: 'POST' });
  return store.save(inner);
};
export default class Shop { buy(n: number) { return axios.get<Row>('/api/rows'); } }
interface Hidden { x: number }
export type T = string;
function local() { console.log(process.env.HOME); createHash('md5'); handler(1); }
app.get('/users/:id', requireAuth, handler);
router.post("/items", local);
axios({ method: 'put', url: '/api/x' });
@Controller('cats')
class Cats {
  @Get(':id')
  @Guard()
  async find(@Param() id) { return this.svc.one(id); }
  @Post()
  add() {}
}
"""


def of(path, text, fact):
    return [x[1:] for x in X.read_facts(path, text) if x[0] == fact]


def test_typescript():
    assert {(n, k, e) for _, _, n, k, _, _, e in of("src/a/b.ts", TS, "symbol")} == {
        ("LIMIT", "const", True), ("handler", "function", True), ("Shop", "class", True), ("Hidden", "interface", False), ("T", "type", True), ("local", "function", False),
        ("Cats", "class", False), ("lazy", "const", False), ("text", "const", False),
    }
    assert [(n, k, t, d) for _, _, n, k, t, d, _ in of("src/a/b.ts", TS, "import")] == [
        ("Router", "value", "express", None), ("default", "value", "express", None), ("Row", "type", "./types.js", "src/a/types.js"), ("*", "value", "../data/store", "src/data/store"),
        ("one", "re-export", "./more", "src/a/more"), ("two", "re-export", "./more", "src/a/more"), ("*", "re-export", "./all", "src/a/all"), ("", "value", "./side", "src/a/side"),
        ("", "dynamic", "./lazy", "src/a/lazy"), ("a", "require", "./old", "src/a/old"),
    ]
    assert [(x[0], x[2], x[3], x[4]) for x in of("b.ts", TS, "route")] == [
        (21, "handler", "GET", "/users/:id"), (22, "local", "POST", "/items"), (26, "find", "GET", "cats/:id"), (29, "add", "POST", "cats"),
    ]
    assert sorted((x[2], x[3], x[4]) for x in of("b.ts", TS, "egress")) == [("axios", "GET", "/api/rows"), ("axios", "PUT", "/api/x"), ("fetch", "POST", "{}/v1/items/{}?x=1")]
    assert {(x[2], x[3]) for x in of("b.ts", TS, "site")} == {("log", "console"), ("HOME", "env"), ("md5", "hash")}
    calls = {(x[2], x[4]) for x in of("b.ts", TS, "call")}
    assert {("store.save", "handler"), ("fetch", "handler"), ("handler", "local"), ("this.svc.one", "find"), ("app.get", None)} <= calls and not any(n in ("local", "find", "add") for n, _ in calls)
    assert of("b.ts", TS.replace("\n", "\r\n"), "route") == of("b.ts", TS, "route") and list(X.read_facts("b.txt", TS)) == []


def test_other_languages():
    go = 'package m\nimport (\n  "fmt"\n  x "net/http"\n)\nfunc Serve(w int) {\n  mux.HandleFunc("GET /a/{id}", show)\n  mux.HandleFunc("/b", other)\n  r.POST("/c", guard, save)\n  http.Get("https://h.example/z")\n}\ntype item struct{}\n'
    assert [(x[2], x[3], x[4]) for x in of("m.go", go, "route")] == [("show", "GET", "/a/{id}"), ("other", "ALL", "/b"), ("save", "POST", "/c")]
    assert [(x[2], x[3], x[6]) for x in of("m.go", go, "symbol")] == [("Serve", "function", True), ("item", "struct", False)]
    assert [x[4] for x in of("m.go", go, "import")] == ["fmt", "net/http"] and [x[4] for x in of("m.go", go, "egress")] == ["https://h.example/z"]
    java = '@RestController\n@RequestMapping("/api")\npublic class A {\n  @GetMapping("/x/{id}")\n  public String one(@PathVariable String id) {\n    return restTemplate.getForObject("http://b/y", String.class);\n  }\n  @DeleteMapping\n  public void drop() { repo.delete(1); }\n}\n'
    assert [(x[2], x[3], x[4]) for x in of("A.java", java, "route")] == [("one", "GET", "api/x/{id}"), ("drop", "DELETE", "api")]
    assert [(x[2], x[3]) for x in of("A.java", java, "symbol")] == [("A", "class"), ("one", "function"), ("drop", "function")] and [x[3] for x in of("A.java", java, "egress")] == ["GET"]
    rust = 'use crate::db::Pool;\nmod inner;\npub async fn list() -> u8 { save(1) }\nfn app() { Router::new().route("/t/:id", get(list).delete(drop_it)); }\n'
    assert [(x[2], x[3]) for x in of("src/lib.rs", rust, "route")] == [("list", "GET"), ("drop_it", "DELETE")] and [x[5] for x in of("src/lib.rs", rust, "import")] == ["src/inner", None] and [x[4] for x in of("src/lib.rs", rust, "import")] == ["inner", "crate::db::Pool"]
    py = 'from .db import save, load\nimport os.path\n@app.route("/p/<int:n>", methods=["GET", "PUT"])\n@login\ndef page(n):\n    return requests.post("https://q.example/r", json={})\nLIMIT = 3\n'
    assert [(x[2], x[3], x[4]) for x in of("web/v.py", py, "route")] == [("page", "GET", "/p/{n}"), ("page", "PUT", "/p/{n}")]
    assert [(x[2], x[5]) for x in of("web/v.py", py, "import")] == [("save", "web/db"), ("load", "web/db"), ("*", "os/path")] and [x[3] for x in of("web/v.py", py, "egress")] == ["POST"]
    cs = '[ApiController]\n[Route("api/[controller]")]\npublic class CatsController {\n  [HttpGet("{id}")]\n  public async Task<Cat> One(int id) { return await client.GetFromJsonAsync<Cat>("/up/x"); }\n}\napp.MapPost("/m", Make);\n'
    assert sorted((x[2], x[3], x[4]) for x in of("c.cs", cs, "route")) == [("Make", "POST", "/m"), ("One", "GET", "api/cats/{id}")] and [x[4] for x in of("c.cs", cs, "egress")] == ["/up/x"]


FILES = [
    ("s", "src/routes.ts", "import { save, read } from './db';\nimport type { T } from './types';\nimport * as util from './util/index.js';\napp.post('/a', add);\napp.post('/b', safe);\napp.get('/c', show);\napp.get('/d', plain);\nfunction add() { save(1); }\nfunction safe() { util.checkAuth(); save(2); }\nfunction show() { util.deep(); }\nfunction plain() { return read(); }\n"),
    ("s", "src/db.ts", "import { help } from './routes';\nexport function save(x) { return db.insert(x); }\nexport function read() { return 1; }\nexport function unused() { return 2; }\nexport const FREE = 1;\n"),
    ("s", "src/util/index.ts", "import { save } from '../db';\nexport function deep() { return save(3); }\nexport function checkAuth() { return requireUser(); }\n"),
    ("s", "src/types.ts", "import type { X } from './routes';\nexport type T = number;\nexport type Lost = string;\n"),
    ("t", "src/call.ts", "import { gone } from './nowhere';\nfetch('/a', { method: 'POST' });\nfetch('https://else.example/q');\n"),
    ("t", None, "x"), ("t", "n.ts", None), ("t", "empty.ts", ""),
]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_relations(spark):
    from codelode.operators import graph, link

    files = spark.createDataFrame([(*f, "clash") for f in FILES], "source string, path string, text string, fact string")
    facts = X.file_facts(files).cache()
    edges = X.import_edges(facts, files)
    deps = X.dependency_edges(edges)
    assert rows(deps.select("src", "dst")) == [
        ("src/db.ts", "src/routes.ts"), ("src/routes.ts", "src/db.ts"), ("src/routes.ts", "src/types.ts"), ("src/routes.ts", "src/util/index.ts"), ("src/types.ts", "src/routes.ts"), ("src/util/index.ts", "src/db.ts"),
    ]
    assert rows(X.unresolved_imports(facts, edges)) == [("t", "src/call.ts", "./nowhere")]
    whole = {r.size for r in graph.cycles(graph.scc(deps.select("src", "dst"))).collect()}
    at_run_time = {r.size for r in graph.cycles(graph.scc(X.dependency_edges(edges, False).select("src", "dst"))).collect()}
    assert whole == {4} and at_run_time == {3}
    assert [(r.file, r.name) for r in X.dead_exports(facts, edges).orderBy("file", "name").collect()] == [("src/db.ts", "FREE"), ("src/db.ts", "unused"), ("src/types.ts", "Lost")]
    calls = X.symbol_graph(facts, edges)
    assert rows(calls.select("src", "dst")) == [
        ("src/routes.ts#add", "src/db.ts#save"), ("src/routes.ts#plain", "src/db.ts#read"), ("src/routes.ts#safe", "src/db.ts#save"), ("src/routes.ts#safe", "src/util/index.ts#checkAuth"),
        ("src/routes.ts#show", "src/util/index.ts#deep"), ("src/util/index.ts#deep", "src/db.ts#save"),
    ]
    assert rows(X.mutating_routes_without_auth(facts, edges, calls).select("line", "key")) == [(4, "POST /a")]
    assert rows(X.unsafe_reads(facts, edges, calls).select("line", "key")) == [(6, "GET /c")]
    got = link.classify(X.consumes(facts), X.provides(facts), []).select("key", "bucket")
    assert rows(got) == [("GET https://else.example/q", "external"), ("POST /a", "edge")]
    assert X.file_facts(files.limit(0)).count() == 0
