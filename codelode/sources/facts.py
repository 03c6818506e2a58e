"""Facts out of source text: symbols, imports, routes, outgoing calls, calls and call sites, by language.

One Arrow pass reads each file once. A pattern counts only where it begins in code,
not in a comment, string or regular expression; the strings it then reads are those
of the text. Rows have one shape for all facts:

  source, path, fact, line, end_line, name, kind, target, detail, exported

  symbol   name, kind (function, class, interface, type, enum, const, struct, trait), exported; its lines
  import   target: the specifier, detail: its path within the tree without extension (null if it
           leads outside), name: what is imported (`*` all, `default`, '' nothing by name), kind:
           value, type, dynamic, require or re-export
  route    kind: the verb (ALL for any), target: the path as written, name: the handler, if it has one
  egress   kind: the verb, target: the address as written (placeholders of templates as {}), name: the client
  call     name: the callee as written, target: the innermost named function around it
  site     kind: console, env, process, hash; name: what is used

Defined results
* Null texts, null paths and unknown extensions have no facts. CRLF and byte-order marks change no line.
* Text that doesn't parse gives what its patterns find; nothing is raised.
* Repeated rows give equal rows; empty tables give none. Only source, path and text are read.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.sources.spans import CONTROL, JS, body_spans, masked

SCHEMA = "source string, path string, fact string, line int, end_line int, name string, kind string, target string, detail string, exported boolean"
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
LANGUAGES = {**dict.fromkeys(JS, "js"), "go": "go", "java": "java", "cs": "cs", "rs": "rs", "py": "py", "pyi": "py"}
_V = "get|post|put|patch|delete|head|options"
_STR = r"(?P<q>['\"`])(?P<s>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)"
_NAMES = re.compile(r"(?:type\s+)?([\w$*]+)(?:\s+as\s+([\w$]+))?")

_SYMBOLS = {
    "js": (
        r"(?m)^[ \t]*(?P<x>export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?"
        r"(?:(?:async\s+)?(?P<k>function|class|interface|enum)\b\s*\*?\s*(?P<n>[\w$]+)|(?P<t>type)\s+(?P<m>[\w$]+)\s*[=<]|(?P<c>const|let|var)\s+(?P<v>[\w$]+)\s*(?::[^=;\n]+)?=(?!=))"
    ),
    "go": r"(?m)^(?P<k>func)\s+(?:\([^()\n]*\)\s*)?(?P<n>\w+)|^type\s+(?P<m>\w+)\s+(?P<t>struct|interface)?|^(?P<c>const|var)\s+(?P<v>\w+)",
    "java": r"(?m)^[ \t]*(?P<x>(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*)(?P<k>class|interface|enum|record|@interface)\s+(?P<n>\w+)",
    "cs": r"(?m)^[ \t]*(?P<x>(?:(?:public|internal|protected|private|static|sealed|abstract|partial)\s+)*)(?P<k>class|interface|enum|record|struct)\s+(?P<n>\w+)",
    "rs": r"(?m)^[ \t]*(?P<x>pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?P<k>fn|struct|enum|trait|mod|type|static)\s+(?:mut\s+)?(?P<n>\w+)",
    "py": r"(?m)^(?:async\s+)?(?P<k>def|class)\s+(?P<n>\w+)|^(?P<c>)(?P<v>[A-Za-z_]\w*)\s*(?::[^=\n]+)?=(?!=)",
}
_KINDS = {"func": "function", "fn": "function", "def": "function", "let": "const", "var": "const", "static": "const", "": "const", "@interface": "interface", "record": "class"}
_METHOD = re.compile(r"(?m)^[ \t]*(?P<x>(?:(?:public|protected|private|internal|static|final|async|override|virtual|synchronized)\s+)+)(?:<[^<>]*>\s*)?[\w<>\[\],.? ]+?\s+(?P<n>\w+)\s*\(")

_IMPORTS = {
    "js": (
        (r"\bimport\s+(?P<type>type\s+)?(?!['\"(])(?:(?P<d>[\w$]+)\s*,?\s*)?(?:\*\s*as\s+(?P<ns>[\w$]+)|\{(?P<names>[^}]*)\})?\s*from\s*" + _STR, "value"),
        (r"\bexport\s+(?P<type>type\s+)?(?:(?P<all>\*)(?:\s*as\s+[\w$]+)?|\{(?P<names>[^}]*)\})\s*from\s*" + _STR, "re-export"),
        (r"\bimport\s*" + _STR, "value"),
        (r"\bimport\s*\(\s*" + _STR + r"\s*\)", "dynamic"),
        (r"(?:\b(?:const|let|var)\s+(?:(?P<d>[\w$]+)|\{(?P<names>[^}]*)\})\s*=\s*)?\brequire\s*\(\s*" + _STR + r"\s*\)", "require"),
    ),
    "py": ((r"(?m)^[ \t]*from\s+(?P<s>[.\w]+)\s+import\s+(?:\((?P<names>[^)]*)\)|(?P<rest>[^\n#]+))", "value"), (r"(?m)^[ \t]*import\s+(?P<s>[\w.]+)", "value")),
    "java": ((r"(?m)^[ \t]*import\s+(?:static\s+)?(?P<s>[\w.*]+)\s*;", "value"),),
    "cs": ((r"(?m)^[ \t]*using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<s>[\w.]+)\s*;", "value"),),
    "rs": ((r"(?m)^[ \t]*(?:pub\s+)?mod\s+(?P<mod>\w+)\s*;", "value"), (r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<s>[\w:]*\w)", "value")),
    "go": ((r"(?m)^import\s+(?:[\w.]+\s+)?\"(?P<s>[^\"\n]+)\"", "value"), (r"(?m)^import\s*\((?P<block>[^)]*)\)", "value")),
}
_CLIENT = r"(?P<n>axios|ky|got|superagent|\$http|this\.http|http|httpClient|apiClient|client|api)"
_ROUTES = {
    "js": rf"\b(?P<o>app|server|api|fastify|[\w$]*[rR]outer|[\w$]*[rR]outes?)\.(?P<v>{_V}|all)\s*\(\s*{_STR}\s*,(?:\s*[\w$.]+(?:\([^()\n]*\))?\s*,)*\s*(?P<h>[\w$.]+)?",
    "go": rf"\b\w+\.(?P<v>HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Any)\s*\(\s*{_STR}\s*,(?:\s*\w+(?:\.\w+)*(?:\([^()\n]*\))?\s*,)*\s*(?P<h>[\w.]+)?",
    "cs": rf"\.Map(?P<v>Get|Post|Put|Patch|Delete)\s*\(\s*{_STR}\s*,\s*(?P<h>[\w.]+)?",
    "rs": rf"\.route\s*\(\s*{_STR}\s*,\s*(?P<chain>(?:\.?\s*(?:\w+::)*(?:{_V}|any)\s*\(\s*[\w:]+\s*\)\s*)+)",
    "py": rf"(?m)^[ \t]*@\w+\.(?P<v>{_V}|route|api_route)\s*\(\s*{_STR}(?P<rest>[^\n]*)\)\s*\n(?:[ \t]*@[^\n]*\n)*[ \t]*(?:async\s+)?def\s+(?P<h>\w+)",
}
#: a class with a prefix, and methods of it with a verb
_CONTROLLERS = {
    "js": (rf"@Controller\s*\(\s*(?:{_STR})?[^)]*\)", rf"@(?P<v>Get|Post|Put|Patch|Delete|Head|Options|All)\s*\(\s*(?:{_STR})?\s*\)", r"\s*(?:@[\w.]+\s*(?:\((?:[^()]|\([^()]*\))*\))?\s*)*(?:(?:public|private|protected|async|static)\s+)*(?P<h>[\w$]+)\s*\("),
    "java": (rf"@RequestMapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\{{?\s*{_STR}[^)]*\)(?=(?:\s*@[\w.]+(?:\([^)]*\))?)*\s*(?:public\s+|abstract\s+|final\s+)*(?:class|interface)\b)", rf"@(?P<v>Get|Post|Put|Patch|Delete)Mapping\b(?:\s*\(\s*(?:(?:value|path)\s*=\s*)?\{{?\s*(?:{_STR})?[^)]*\))?", r"\s*(?:@[\w.]+\s*(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final)\s+)*[\w<>\[\],.? ]+?\s+(?P<h>\w+)\s*\("),
    "cs": (rf"\[Route\s*\(\s*{_STR}\s*\)\](?=(?:\s*\[[^\]]*\])*\s*(?:public\s+|abstract\s+|sealed\s+)*class\s+(?P<cls>\w+))", rf"\[Http(?P<v>Get|Post|Put|Patch|Delete|Head|Options)(?:\s*\(\s*(?:{_STR})?[^)\]]*\))?\]", r"\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|async|static|virtual)\s+)*[\w<>\[\],.? ]+?\s+(?P<h>\w+)\s*\("),
}
_EGRESS = {
    "js": (
        rf"(?<![\w$.])(?P<n>fetch)\s*\(\s*{_STR}(?P<rest>\s*,\s*\{{[^{{}}]*?\bmethod\s*:\s*['\"](?P<m>\w+)['\"])?",
        rf"(?<![\w$.]){_CLIENT}\.(?P<v>{_V})\s*(?:<[^()]*?>)?\s*\(\s*{_STR}",
        rf"(?<![\w$.])(?P<n>axios)\s*(?:\.request)?\s*\(\s*\{{(?P<body>[^{{}}]*)\}}",
    ),
    "go": (rf"\b(?P<n>http)\.(?P<v>Get|Post|Head|PostForm)\s*\(\s*{_STR}", rf"\b(?P<n>http)\.NewRequest(?:WithContext)?\s*\((?:\s*\w+\s*,)?\s*(?:\"(?P<m>\w+)\"|http\.Method(?P<mm>\w+))\s*,\s*{_STR}"),
    "java": (rf"\b(?P<n>\w*[rR]estTemplate)\.(?P<v>get|post|put|patch|delete)(?:For\w+)?\s*\(\s*{_STR}", rf"\b(?P<n>\w*[wW]ebClient|\w*[rR]estClient)\s*\.\s*(?P<v>{_V})\s*\(\s*\)\s*\.\s*uri\s*\(\s*{_STR}"),
    "cs": (rf"\b(?P<n>\w*[cC]lient|_http\w*)\.(?P<v>Get|Post|Put|Patch|Delete)\w*Async(?:<[^()]*>)?\s*\(\s*\$?{_STR}",),
    "rs": (rf"\b(?P<n>reqwest|client|http)(?:::|\.)(?:blocking::)?(?P<v>{_V})\s*\(\s*&?{_STR}",),
    "py": (rf"\b(?P<n>requests|httpx|session|client)\.(?P<v>{_V})\s*\(\s*f?{_STR}",),
}
_SITES = {
    "js": ((r"\bconsole\.(?P<n>\w+)\s*\(", "console"), (r"\bprocess\.env(?:\.(?P<n>\w+)|\[['\"](?P<e>\w+)['\"]\])", "env"), (r"\b(?:child_process\.)?(?P<n>exec|execSync|execFile|execFileSync|spawn|spawnSync|fork)\s*\(", "process"), (r"\bcreateHash\s*\(\s*['\"](?P<n>[\w-]+)['\"]", "hash")),
    "py": ((r"\b(?P<n>print)\s*\(", "console"), (r"\bos\.(?:environ(?:\.get\s*\(|\[)|getenv\s*\()\s*['\"](?P<n>\w+)['\"]", "env"), (r"\b(?:subprocess\.(?P<n>\w+)|os\.(?P<e>system|popen))\s*\(", "process"), (r"\bhashlib\.(?P<n>\w+)\s*\(", "hash")),
    "go": ((r"\bfmt\.(?P<n>Print\w*)\s*\(", "console"), (r"\bos\.(?:Getenv|LookupEnv)\s*\(\s*\"(?P<n>\w+)\"", "env"), (r"\bexec\.(?P<n>Command\w*)\s*\(", "process"), (r"\b(?P<n>md5|sha1|sha256|sha512)\.(?:New|Sum\w*)\s*\(", "hash")),
    "java": ((r"\bSystem\.(?:out|err)\.(?P<n>\w+)\s*\(", "console"), (r"\bSystem\.getenv\s*\(\s*\"(?P<n>\w+)\"", "env"), (r"\bRuntime\.getRuntime\(\)\.(?P<n>exec)\s*\(", "process"), (r"\bMessageDigest\.getInstance\s*\(\s*\"(?P<n>[\w-]+)\"", "hash")),
}
_CALL = re.compile(r"(?<![\w$.@#])(?P<n>[A-Za-z_$][\w$]*(?:(?:\.|::|\?\.)[A-Za-z_$][\w$]*)*)\s*(?:<[\w$, ]*>)?\(")
_NO_CALL = CONTROL | {"and", "or", "not", "in", "is", "print", "super", "typeof", "await", "new", "class", "def", "fn", "import", "require", "constructor", "assert", "del", "elif", "defer", "go", "range", "select", "case", "catch", "throw", "yield", "delete", "void", "lambda", "except", "unless", "where", "impl", "pub", "use", "mod", "let", "const", "var", "public", "private", "protected", "static"}
_HEAD = re.compile(r"\b(?:function\s*\*?|func(?:\s*\([^()\n]*\))?|fn|def|class|interface|record)\s+\Z")
_COMPILED: dict[str, re.Pattern] = {}


def _find(pattern: str, text: str, code: str) -> Iterator[re.Match]:
    """Matches that begin in code."""
    p = _COMPILED.get(pattern)
    if p is None:
        p = _COMPILED[pattern] = re.compile(pattern)
    for m in p.finditer(text):
        first = m.start() + len(m.group()) - len(m.group().lstrip())
        if code[first : first + 1].strip():
            yield m


def _group(m: re.Match, name: str) -> str | None:
    return m[name] if name in m.re.groupindex else None


def _names(listed: str | None) -> list[str]:
    return [m[1] for part in (listed or "").split(",") if (m := _NAMES.match(part.strip()))]


def _base(path: str, spec: str, language: str) -> str | None:
    """Where a specifier leads within the tree, without extension."""
    folder = posixpath.dirname(path)
    if language == "js":
        return posixpath.normpath(posixpath.join(folder, spec)) if spec.startswith(".") else None
    if language == "py":
        dots = len(spec) - len(spec.lstrip("."))
        for _ in range(dots - 1):
            folder = posixpath.dirname(folder)
        rest = spec.lstrip(".").replace(".", "/")
        return posixpath.normpath(posixpath.join(folder, rest)) if dots else rest
    return None


def _address(text: str) -> str:
    return re.sub(r"\$?\{[^{}]*\}", "{}", text)


def read_facts(path: str, text: str) -> Iterator[tuple]:
    """(fact, line, end_line, name, kind, target, detail, exported) of a file."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    language = LANGUAGES.get(ext)
    if language is None:
        return
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    code = masked(text, "java" if language == "cs" else language)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at - 1) + 1 if at else 1
    functions = [(a, b) for a, b, _ in body_spans(path, text)]
    ends = dict(reversed(functions))

    def first_line(m: re.Match) -> int:
        return line(m.start() + len(m.group()) - len(m.group().lstrip()))

    # --- symbols; of blocks within others only functions, classes and the like
    owners: list[tuple[int, int, str]] = []
    depth_at, level = [], 0
    for m in re.finditer(r"[{}]", code):
        level += 1 if m.group() == "{" else -1
        depth_at.append((m.start(), level))
    places = [p for p, _ in depth_at]
    outside = lambda at: (i := bisect_right(places, at - 1)) == 0 or depth_at[i - 1][1] <= 0
    for m in _find(_SYMBOLS[language], text, code):
        name = m["n"] or _group(m, "m") or _group(m, "v")
        kind = m["k"] or _group(m, "t") or ("type" if _group(m, "m") else _group(m, "c"))
        constant = kind in ("const", "let", "var", "")
        if name is None or (constant and not outside(m.start())) or (kind == "mod" and text[m.end() : m.end() + 1] == ";"):
            continue
        at = first_line(m)
        kind = _KINDS.get(kind, kind)
        if constant and at in ends:
            kind = "function"  # a function that is bound to a name
        visible = {"js": lambda: bool(m["x"]), "go": lambda: name[0].isupper(), "py": lambda: not name.startswith("_"), "rs": lambda: bool(m["x"])}
        end = ends.get(at, at)
        if kind == "function":
            owners.append((at, end, name))
        yield "symbol", at, end, name, kind, None, None, bool(visible.get(language, lambda: "public" in m["x"])())
    if language in ("java", "cs"):
        for m in _METHOD.finditer(code):
            if m["n"] not in CONTROL and first_line(m) in ends:
                at = first_line(m)
                owners.append((at, ends[at], m["n"]))
                yield "symbol", at, ends[at], m["n"], "function", None, None, "public" in m["x"]
    elif language == "js":
        known = {a for a, _, _ in owners}
        for at, end in functions:
            m = re.match(r"\s*(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*\*?([\w$]+)\s*(?:<[^<>]*>)?\(", code[breaks[at - 2] + 1 if at > 1 else 0 :][:300])
            if at not in known and m and m[1] not in CONTROL:
                owners.append((at, end, m[1]))

    # --- imports
    for pattern, kind in _IMPORTS[language]:
        for m in _find(pattern, text, code):
            at = first_line(m)
            block = _group(m, "block")
            if block is not None:
                for b in re.finditer(r"\"([^\"\n]+)\"", block):
                    yield "import", line(m.start("block") + b.start()), None, "*", kind, b[1], None, None
                continue
            if _group(m, "mod"):
                stem = posixpath.basename(path).rsplit(".", 1)[0]
                folder = posixpath.dirname(path)
                yield "import", at, None, "*", kind, m["mod"], posixpath.join(folder if stem in ("mod", "lib", "main") else posixpath.join(folder, stem), m["mod"]), None
                continue
            spec = m["s"]
            own = "type" if _group(m, "type") else kind
            listed = _names(_group(m, "names") or _group(m, "rest"))
            if _group(m, "d"):
                listed.append("default" if kind == "value" else "*")
            if _group(m, "ns") or _group(m, "all") or (language != "js" and not listed):
                listed.append("*")
            for name in listed or [""]:
                yield "import", at, None, name, own, spec, _base(path, spec, language), None

    # --- routes
    if language in _ROUTES:
        for m in _find(_ROUTES[language], text, code):
            at, target = first_line(m), m["s"]
            if language == "rs":
                for c in re.finditer(rf"({_V}|any)\s*\(\s*([\w:]+)\s*\)", m["chain"]):
                    yield "route", at, None, c[2].split("::")[-1], "ALL" if c[1] == "any" else c[1].upper(), target, None, None
                continue
            v = m["v"].upper()
            verbs = [v]
            if language == "go" and v in ("HANDLEFUNC", "HANDLE"):
                named = re.match(r"([A-Z]+)\s+(.*)", target)
                verbs, target = ([named[1]], named[2]) if named else (["ALL"], target)
            elif v in ("ANY", "ALL"):
                verbs = ["ALL"]
            elif v in ("ROUTE", "API_ROUTE"):
                verbs = [x.upper() for x in re.findall(r"['\"](\w+)['\"]", (re.search(r"methods\s*=\s*[\[({]([^\])}]*)", m["rest"]) or [""] * 2)[1])] or ["GET"]
            handler = (_group(m, "h") or "").split(".")[-1]
            for x in verbs:
                yield "route", at, None, handler if handler not in ("async", "function", "func") else "", x, re.sub(r"<(?:\w+:)?(\w+)>", r"{\1}", target) if language == "py" else target, None, None
    if language in _CONTROLLERS:
        klass, method, head = _CONTROLLERS[language]
        prefixes = [(m.start(), (m["s"] or "").replace("[controller]", re.sub("Controller$", "", _group(m, "cls") or "").lower())) for m in _find(klass, text, code)]
        for m in _find(method, text, code):
            above = [p for at, p in prefixes if at < m.start()]
            if not above and language != "java":
                continue
            h = re.compile(head).match(text, m.end())
            yield "route", line(m.start()), None, h["h"] if h else "", m["v"].upper(), "/".join(x.strip("/") for x in (above[-1] if above else "", m["s"] or "") if x.strip("/")), None, None

    # --- outgoing calls
    for pattern in _EGRESS[language]:
        for m in _find(pattern, text, code):
            body = _group(m, "body")
            if body is not None:
                url, verb = re.search(r"\burl\s*:\s*(['\"`])([^'\"`\n]*)\1", body), re.search(r"\bmethod\s*:\s*['\"](\w+)", body)
                if url:
                    yield "egress", first_line(m), None, m["n"], verb[1].upper() if verb else "GET", _address(url[2]), None, None
                continue
            verb = _group(m, "m") or _group(m, "mm") or _group(m, "v") or "GET"
            address = _address(m["s"])
            if "/" in address:
                yield "egress", first_line(m), None, m["n"], {"POSTFORM": "POST"}.get(verb.upper(), verb.upper()), address, None, None

    # --- call sites and calls
    for pattern, kind in _SITES.get(language, ()):
        for m in _find(pattern, text, code):
            yield "site", first_line(m), None, m["n"] or _group(m, "e"), kind, None, None, None
    owners.sort(key=lambda o: (o[0], -o[1]))
    starts = [o[0] for o in owners]
    for m in _CALL.finditer(code):
        name = m["n"].replace("?.", ".")
        if name in _NO_CALL or name.split(".")[0] in ("function",) or _HEAD.search(code, max(0, m.start() - 120), m.start()):
            continue
        at = line(m.start())
        i = bisect_right(starts, at) - 1
        while i >= 0 and not owners[i][0] <= at <= owners[i][1]:
            i -= 1
        if i >= 0 and owners[i][0] == at and owners[i][2] == name:
            continue  # its own head
        yield "call", at, None, name, None, owners[i][2] if i >= 0 else None, None, None


def file_facts(files: DataFrame) -> DataFrame:
    """The facts of every file, in the shape above."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fact", "line", "end_line", "name", "kind", "target", "detail", "exported"]
        types = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.bool_()]
        for batch in batches:
            at, rows = [], []
            for i, (p, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = dict.fromkeys(read_facts(p, t))  # one fact, one row
                at += [i] * len(own)
                rows += own
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["source", "path", *names])

    return files.where(F.col("text").isNotNull() & F.col("path").isNotNull()).select("source", "path", "text").mapInArrow(read, SCHEMA)


# --- relations of the facts


def symbols(facts: DataFrame) -> DataFrame:
    s = facts.where("fact = 'symbol'")
    return s.select("source", F.concat_ws("#", "path", "name").alias("id"), F.col("path").alias("file"), "name", "kind", "line", "exported", F.col("line").alias("body_start"), F.col("end_line").alias("body_end"))


def provides(facts: DataFrame) -> DataFrame:
    """Routes as interface keys; a route for any verb provides each of the common ones."""
    r = facts.where("fact = 'route'")
    verb = F.explode(F.when(F.col("kind") == "ALL", F.array(*[F.lit(v) for v in VERBS[:5]])).otherwise(F.array("kind")))
    r = r.withColumn("verb", verb)
    return r.select("source", F.lit("http").alias("kind"), S.http_key(F.col("verb"), F.col("target")).alias("key"), F.col("path").alias("file"), "line", F.col("name").alias("symbol"))


def consumes(facts: DataFrame) -> DataFrame:
    """Outgoing calls as interface keys; whole addresses keep their host, one that begins with a placeholder has none."""
    e = facts.where("fact = 'egress'")
    rest = F.regexp_replace(F.col("target"), r"^\{\}(?=/)", "")
    key = F.when(rest.contains("://"), F.concat(F.col("kind"), F.lit(" "), rest)).when(rest.startswith("/"), S.http_consume_key(F.col("kind"), rest))
    return e.select(F.xxhash64("source", "path", "line", "target", "kind").alias("id"), "source", F.lit("http").alias("kind"), key.alias("key"), F.col("path").alias("file"), "line")


_SUFFIXES = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi", ".rs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/__init__.py", "/mod.rs"]


def import_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(source, src, dst, name, kind): imports whose specifier leads to a file of the tree; the first suffix that fits counts."""
    i = facts.where("fact = 'import' AND detail IS NOT NULL").select("source", F.col("path").alias("src"), "name", "kind", "detail").distinct()
    stem = F.regexp_replace("detail", r"\.[mc]?js$", "")  # a specifier may name what the file is compiled to
    tries = F.array(*[F.struct(F.lit(n).alias("n"), F.concat(d, F.lit(x)).alias("dst")) for n, (d, x) in enumerate((d, x) for d in (F.col("detail"), stem) for x in _SUFFIXES)])
    known = files.where(F.col("path").isNotNull()).select("source", F.col("path").alias("dst")).distinct()
    met = i.withColumn("t", F.explode(tries)).select("source", "src", "name", "kind", "t.n", "t.dst").join(known, ["source", "dst"])
    return met.groupBy("source", "src", "name", "kind").agg(F.min_by("dst", "n").alias("dst")).select("source", "src", "dst", "name", "kind")


def dependency_edges(edges: DataFrame, with_types: bool = True) -> DataFrame:
    """(source, src, dst) of files; edges that carry types alone can be left out, as they don't exist at run time."""
    e = edges if with_types else edges.where("kind <> 'type'")
    return e.select("source", "src", "dst").where("src <> dst").distinct()


def unresolved_imports(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, path, target): relative specifiers that lead to no file."""
    i = facts.where("fact = 'import' AND detail IS NOT NULL AND target LIKE '.%'").select("source", F.col("path").alias("src"), "name", "kind", "target")
    return i.join(edges.select("source", "src", "name", "kind"), ["source", "src", "name", "kind"], "left_anti").select("source", F.col("src").alias("path"), "target").distinct()


def dead_exports(facts: DataFrame, edges: DataFrame, entry: str = r"(?:^|/)(?:index|main|app|server|cli)\.\w+$|\.(?:test|spec|stories|config)\.|(?:^|/)(?:pages|app|routes)/") -> DataFrame:
    """(source, file, name, kind, line): exports of files that nobody imports by name, nor whole; entry files and route handlers aside."""
    s = symbols(facts).where(F.col("exported") & F.col("file").rlike(r"\.[mc]?[jt]sx?$") & ~F.col("file").rlike(entry)).select("source", "file", "name", "kind", "line")
    whole = edges.where("name IN ('*', '') AND kind <> 'value' OR name = '*'").select("source", F.col("dst").alias("file")).distinct()
    named = edges.select("source", F.col("dst").alias("file"), "name").distinct()
    handlers = facts.where("fact = 'route'").select("source", F.col("path").alias("file"), "name").distinct()
    return s.join(whole, ["source", "file"], "left_anti").join(named, ["source", "file", "name"], "left_anti").join(handlers, ["source", "file", "name"], "left_anti").distinct()


def symbol_graph(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, src, dst): calls between symbols `path#name`: of the same file first, else of a file that is imported by that name or whole."""
    c = facts.where("fact = 'call' AND target IS NOT NULL").select("source", "path", F.concat_ws("#", "path", "target").alias("src"), F.regexp_extract("name", r"([\w$]+)$", 1).alias("callee"), F.col("name").contains(".").alias("member")).distinct()
    defined = facts.where("fact = 'symbol' AND kind IN ('function', 'class', 'const')").select("source", F.col("path").alias("file"), F.col("name").alias("callee"), "exported").distinct()
    own = c.join(defined.select("source", F.col("file").alias("path"), "callee"), ["source", "path", "callee"]).select("source", "src", F.concat_ws("#", "path", "callee").alias("dst"))
    rest = c.join(own.select("source", "src", F.substring_index("dst", "#", -1).alias("callee")), ["source", "src", "callee"], "left_anti")
    named = edges.where("name NOT IN ('*', '', 'default')").select("source", F.col("src").alias("path"), F.col("dst").alias("file"), F.col("name").alias("callee"))
    whole = edges.where("name = '*'").select("source", F.col("src").alias("path"), F.col("dst").alias("file"))
    by_name = rest.where("NOT member").join(named, ["source", "path", "callee"])
    by_member = rest.where("member").join(whole, ["source", "path"])
    far = by_name.select("source", "src", "file", "callee").unionByName(by_member.select("source", "src", "file", "callee"))
    out = far.join(defined.where("exported").drop("exported"), ["source", "file", "callee"]).select("source", "src", F.concat_ws("#", "file", "callee").alias("dst"))
    return own.unionByName(out).distinct()


#: names that guard a route, and calls that write (fixed values)
AUTH = r"(?i)auth|guard|permission|require(?:user|login|role|session)|ensure(?:user|login|role)|isadmin|verify(?:token|jwt|session)|currentuser|getsession"
WRITES = r"(?i)(?:^|[._])(?:insert|update|upsert|delete|remove|destroy|save|create|put|write|persist|exec)(?:many|one|all|async)?$"


def _reached(facts: DataFrame, graph: DataFrame, pattern: str) -> DataFrame:
    """(source, id): symbols from which a call of such a name is reached."""
    from codelode.operators.graph import reachable

    node = F.concat_ws("\u0001", "source", "id")
    hit = facts.where(F.col("fact").isin("call") & F.col("target").isNotNull() & F.col("name").rlike(pattern)).select("source", F.concat_ws("#", "path", "target").alias("id")).distinct()
    back = graph.select(F.concat_ws("\u0001", "source", "dst").alias("src"), F.concat_ws("\u0001", "source", "src").alias("dst"))
    found = reachable(back, hit.select(node.alias("node")))
    return found.select(F.substring_index("node", "\u0001", 1).alias("source"), F.substring_index("node", "\u0001", -1).alias("id"))


def _handled(facts: DataFrame, edges: DataFrame, verbs: list[str]) -> DataFrame:
    """(source, path, line, key, id): routes of these verbs with the symbol that handles them, in the same file or an imported one."""
    r = facts.where(F.col("fact") == "route").where(F.col("kind").isin(*verbs) & (F.col("name") != ""))
    r = r.select("source", "path", "line", S.http_key(F.col("kind"), F.col("target")).alias("key"), "name")
    e = edges.where("name NOT IN ('*', '')").select("source", F.col("src").alias("path"), "name", F.col("dst").alias("file")).distinct()
    return r.join(e, ["source", "path", "name"], "left").select("source", "path", "line", "key", F.concat_ws("#", F.coalesce("file", "path"), "name").alias("id"))


def mutating_routes_without_auth(facts: DataFrame, edges: DataFrame, graph: DataFrame, auth: str = AUTH) -> DataFrame:
    """(source, path, line, key): routes of writing verbs whose handler reaches no call that guards, in files without a guarding call at top level."""
    routes = _handled(facts, edges, ["POST", "PUT", "PATCH", "DELETE"])
    guarded = _reached(facts, graph, auth)
    files = facts.where(F.col("fact") == "call").where(F.col("target").isNull() & F.col("name").rlike(auth)).select("source", "path").distinct()
    return routes.join(guarded, ["source", "id"], "left_anti").join(files, ["source", "path"], "left_anti").select("source", "path", "line", "key").distinct()


def unsafe_reads(facts: DataFrame, edges: DataFrame, graph: DataFrame, writes: str = WRITES) -> DataFrame:
    """(source, path, line, key): GET routes whose handler reaches a call that writes."""
    return _handled(facts, edges, ["GET", "HEAD"]).join(_reached(facts, graph, writes), ["source", "id"], "left_semi").select("source", "path", "line", "key").distinct()
