"""Function bodies in every language of the table `files`."""

import pytest

from codelode.operators import rules
from codelode.sources.spans import body_spans

TEXTS = {
    "a.ts": (
        "import x from 'y';\nclass A<T> extends B {\n  name = 'a';\n  constructor(private readonly db: Db) {\n    super();\n  }\n  async find({ id }: { id: number }): Promise<{ a: string }> {\n    if (id) { return q('}'); }\n  }\n"
        "  get size(): number { return 1; }\n  both<A, B>(a: A, b: B): Map<A, B> { return 2; }\n  load = async (k: string): Promise<void> => {\n    run(k);\n  };\n}\nexport const top = (a: number) => a + 1;\nconst wrap = useCallback(async () => {\n  go();\n});\n",
        [(4, 6), (7, 9), (10, 10), (11, 11), (12, 14), (16, 16), (17, 19)],
    ),
    "a.tsx": ("export function V(p: P) {\n  const cb = () => {\n    hit();\n  };\n  return <div onClick={() => { go(); }}>Don't {p.x}</div>;\n}\nexport default () => {\n  end();\n};\n", [(1, 6), (2, 4), (7, 9)]),
    "a.js": ("const re = /\\/\\*+\\s*['\"]{x/g;\nconst o = {\n  m(a) {\n    if (a) {\n      b();\n    }\n  },\n  n: function () {\n    c();\n  },\n};\napp.get('/x', async (req, res) => {\n  d();\n});\nfunction f() { return `{${o}`; }\n", [(3, 7), (8, 10), (12, 14), (15, 15)]),
    "a.mjs": ("export const f = async x => {\n  a();\n}\nexport async function* g() {\n  b();\n}\n", [(1, 3), (4, 6)]),
    "a.py": ("class A:\n    @property\n    def x(self):\n        def y():\n            return 1\n        return y\n\n    async def z(self):\n        pass\n\nQ = 1\n", [(3, 6), (4, 5), (8, 9)]),
    "broken.PY": ("def a():\n    s = \"\"\"\nx\n\"\"\"\n    return (\n  1)\nprint 'no'\ndef b(\n    x,\n):\n    pass\n", [(1, 6), (8, 11)]),
    "a.rs": ("pub async fn a<'x>(s: &'x str) -> Option<u32>\nwhere\n    T: X,\n{\n    fn inner(c: char) -> bool { c == '{' }\n    s.map(|v| { v });\n    r#\"}\"#;\n}\ntrait T { fn no(&self); fn yes(&self) { 1 } }\nimpl X { pub(crate) fn m(&self) {\n    1\n} }\n", [(1, 8), (5, 5), (9, 9), (10, 12)]),
    "a.java": (
        "package p;\npublic class A {\n  private static final Map<String, List<X>> M = new HashMap<>();\n  @GetMapping(\"/x\")\n  public List<Map<String, X>> get(@Param(\"a\") int a, List<X> b) throws E, F {\n    if (a > 1) {\n      run(() -> { go(); });\n    }\n    char c = '\"';\n  }\n"
        "  A(int x) { this.x = x; }\n  abstract void none(int a);\n  static class B { void in() {\n    new Thread(r) { public void run() { hit(); } };\n  } }\n}\n",
        [(5, 10), (11, 11), (13, 15), (14, 14)],
    ),
    "a.go": ("package p\n\ntype S struct {\n\tcb func(int) error\n}\n\nfunc (r *S) Name(x interface{}) (interface{}, error) {\n\tq := '\\''\n\tgo func() {\n\t\tgo1()\n\t}()\n}\n\nfunc Gen[T any](x T) T {\n\treturn x\n}\n\nvar f = func(a int) {\n\trun(a)\n}\n", [(7, 12), (14, 16), (18, 20)]),
    "a.sql": ("SELECT 1;\nCREATE OR REPLACE FUNCTION f() RETURNS int AS $$\nBEGIN\n  SELECT a FROM b;\nEND\n$$ LANGUAGE plpgsql;\n", [(2, 6)]),
    "a.cs": ("class A {\n  public A(int x) : base(x) {\n    y();\n  }\n  public int Get<T>(int a) where T : X {\n    return 1;\n  }\n  int Sum(int a) => a + 1;\n}\n", [(2, 4), (5, 7), (8, 8)]),
}


@pytest.mark.parametrize("path", TEXTS)
def test_bodies(path):
    text, want = TEXTS[path]
    assert [(a, b) for a, b, _ in body_spans(path, text)] == want
    assert [(a, b) for a, b, _ in body_spans(path, "\ufeff" + text.replace("\n", "\r\n"))] == want


def test_each_place_belongs_to_its_innermost_function():
    (_, _, outer), (_, _, inner) = body_spans("a.js", "function f() { a(); const g = () => { b(); }; c(); }")
    assert "b()" not in outer[0] and "a()" in outer[0] and "c()" in outer[0] and "b()" in inner[0] and "a()" not in inner[0]
    assert len(list(body_spans("min.js", "function f(){a()}function g(){b()}const h=x=>b(x),i=()=>{c()};"))) == 4


def test_method_scan_in_every_language(spark):
    bodies = {
        "m.java": "class A {\n  void a() {\n    if (x) q(\"SELECT id\");\n  }\n  void b() {\n    q(\"SELECT id\");\n  }\n}\n",
        "m.ts": "class A {\n  a() {\n    if (x) q('SELECT id');\n  }\n  b = async () => {\n    q('SELECT id');\n  };\n}\n",
        "m.tsx": "const a = () => {\n  if (x) q('SELECT id');\n};\n\nconst b = () => {\n  q('SELECT id');\n};\n",
        "m.js": "const o = {\n  a() { if (x) q('SELECT id'); },\n\n\n  b() {\n    q('SELECT id');\n  },\n};\n",
        "m.mjs": "if (x) {\n  q('SELECT none');\n}\n\nexport const b = async (y) => {\n  q('SELECT id');\n};\n",
        "m.go": "func (r T) a() {\n\tif x { q(`SELECT id`) }\n}\n\nfunc (r T) b() {\n\tq(`SELECT id`)\n}\n",
        "m.rs": "impl A {\n  pub fn a() { if x { q(\"SELECT id\") } }\n\n\n  pub(crate) async fn b() {\n    q(\"SELECT id\");\n  }\n}\n",
        "m.py": "class A:\n  def a(self):\n    if x: q('SELECT id')\n\n  def b(self):\n    q('SELECT id')\n\nif x:\n  pass\n",
        "m.sql": "SELECT id;\n\n\n\nCREATE FUNCTION b() AS $$\n  SELECT id;\n$$;\n",
    }
    f = spark.createDataFrame([("s", p, t) for p, t in bodies.items()], "source string, path string, text string")
    rule = {"id": "query-unguarded", "patterns": [r"SELECT \w+"], "absent": [r"\bif\b"]}
    assert sorted((r.path, r.start, r.line) for r in rules.method_scan(f, [rule]).collect()) == sorted((p, 5, 6) for p in bodies)
