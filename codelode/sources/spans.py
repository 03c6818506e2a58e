"""Bodies of functions by language: braces with strings and comments masked, Python's own syntax tree, dollar-quoted SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.sources.code import python_facts

JS = {"ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"}
#: words before a parenthesis and a block that are no names of functions (fixed values)
CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "with", "synchronized", "try", "using", "lock", "fixed", "match", "loop", "return", "else", "elseif", "when", "function", "func"}
_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_LINE_STRING = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_JS_REGEX = r"(?:(?<=[=(\[{,;:!&|?+*%~^])|(?<=[=(\[{,;:!&|?+*%~^]\s)|(?<==>\s)|(?<=\breturn\s))/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_CHAR = r"'(?:\\[^\n']*'|\\''|[^'\\\n]')"
_MASK = {
    "js": re.compile(rf"{_COMMENT}|{_LINE_STRING}|`(?:\\[\s\S]|[^`\\])*`|{_JS_REGEX}"),
    "go": re.compile(rf"{_COMMENT}|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|{_CHAR}"),
    "rs": re.compile(rf"{_COMMENT}|\bb?r(#*)\"[\s\S]*?\"\1|\"(?:\\[\s\S]|[^\"\\])*\"|{_CHAR}"),
    "java": re.compile(rf"{_COMMENT}|\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|@\"(?:\"\"|[^\"])*\"|\"(?:\\.|[^\"\\\n])*\"|{_CHAR}"),
    "py": re.compile(r"\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|#[^\n]*|" + _LINE_STRING),
}
_HIDE = re.compile(r"[^\n]")
_TOKEN = re.compile(r"[(){}\[\];,\n]|=>|->|\b(?:function|func|fun|fn)\b")
_TYPED = r"(?::\s*[^\s;=:?][^;=?]*)?"
_TAIL = {
    "js": re.compile(rf"\s*{_TYPED}\s*"),
    "java": re.compile(r"\s*(?:throws\s[^;{}=]*|where\s[^;{}=]*)?\s*"),
}
_NAME = re.compile(r"(?:(\b[\w$]+)\s+)?([.#]?)([\w$]+|\])\s*(?:<[^<>()]*>)?\s*\Z")
_BOUND = re.compile(r"(?:\b(?:const|let|var)\s+)?[\w$#.]+\s*(?::[^=;]*)?=\s*(?:async\s*)?(?:<[^<>()]*>\s*)?\Z")
_HEADS = {"function": re.compile(r"function\s*\*?\s*[\w$]+"), "func": re.compile(r"func\s+(?:\([^()]*\)\s*)?\w+\s*[\[(<]"), "fn": re.compile(r"fn\s+\w+"), "fun": re.compile(r"fun\s+[\w.<]+")}
_SQL = re.compile(r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+[\s\S]*?\$(\w*)\$[\s\S]*?\$\1\$")
_DEF = re.compile(r"([ \t]*)(?:async\s+)?def\s+\w+")
_PAIR = {")": "(", "]": "[", "}": "{"}


class _Frame:
    """An open bracket: where a statement in it begins, the last closed parenthesis, a head that waits for its block, arrows without a block."""

    __slots__ = ("bracket", "arrows", "head", "mark", "named", "paren", "pending", "start", "type")

    def __init__(self, bracket: str, start: int):
        self.bracket, self.start, self.mark = bracket, start, start + 1
        self.head = self.paren = self.pending = None
        self.named = self.type = False
        self.arrows = []


def masked(text: str, language: str) -> str:
    """The text with strings, comments and regular expressions blanked, at equal places."""
    return _MASK[language].sub(lambda m: _HIDE.sub(" ", m.group()), text)


def _brace_spans(text: str, ext: str) -> list[tuple[int, int]]:
    """Named functions and methods at any depth, and nameless ones that no function holds: [begin, end) in the text."""
    language = ext if ext in ("go", "rs") else "java" if ext in ("java", "cs") else "js"
    code = masked(text, language)
    arrow = {"java": "->", "cs": "=>"}.get(ext, "=>" if language == "js" else "")
    stack, found = [_Frame("", -1)], []

    def begin(f: _Frame, at: int) -> int:
        """Where the statement or the line that holds `at` begins, whichever is later; annotations aside."""
        p = max(f.mark, code.rfind("\n", 0, at) + 1)
        m = re.compile(r"\s*(?:@[\w.]+\s*(?:\([^()]*\))?\s*)*").match(code, p, at)
        return m.end() if m else p

    def inside() -> bool:
        return any(f.head is not None or f.arrows for f in stack)

    def stop_arrows(f: _Frame, at: int) -> None:
        while f.arrows:
            found.append((f.arrows.pop()[0], at))

    def close(f: _Frame, at: int) -> None:
        stop_arrows(f, at)
        if f.head is not None:
            found.append((f.head, at + 1))

    def arrow_head(f: _Frame, at: int) -> tuple[int, bool]:
        """(begin, named) of the function whose arrow stands at `at`."""
        if f.paren and f.paren[0] >= f.mark and _TAIL["js"].fullmatch(code, f.paren[1] + 1, at):
            first = f.paren[0]
        else:
            m = re.compile(r"[\w$]+\s*\Z").search(code, f.mark, at)
            first = m.start() if m else at
        m = _BOUND.search(code, max(f.mark, first - 500), first)
        if m:
            return begin(f, m.start()), True
        if ext == "cs" and f.bracket == "{" and not inside():
            return begin(f, first), True
        return begin(f, first), False

    for t in _TOKEN.finditer(code):
        top, k, at = stack[-1], t.group(), t.start()
        if k in "([":
            stack.append(_Frame(k, at))
        elif k == "{":
            f, last = _Frame("{", at), code[max(0, at - 300) : at].rstrip()
            f.type = (language == "js" and (last.endswith((":", "<", "|", "&")) and bool(top.paren or top.pending))) or (language == "go" and re.search(r"\b(interface|struct)\Z", last) is not None)
            if f.type:
                pass
            elif top.pending:
                head, named = top.pending
                if named or not inside():
                    f.head, f.named = head, named
                top.pending = None
            elif arrow and last.endswith(arrow):
                head, named = arrow_head(top, code.rindex(arrow, 0, at))
                top.arrows = [a for a in top.arrows if a[1] != top.mark]
                if named or not inside():
                    f.head, f.named = head, named
            elif language in _TAIL and top.paren and top.bracket != "(" and _TAIL[language].fullmatch(code, top.paren[1] + 1, at):
                m = _NAME.search(code, max(top.mark, top.paren[0] - 200), top.paren[0])
                if m and m.group(2) != "." and m.group(3) not in CONTROL and m.group(1) not in ("new", "record", "class", "enum", "interface"):
                    f.head, f.named = begin(top, m.start(3)), True
            stack.append(f)
        elif k in ")]}":
            if not any(f.bracket == _PAIR[k] for f in stack):
                continue
            while True:
                f = stack.pop()
                matched = f.bracket == _PAIR[k]
                close(f, at)
                if matched:
                    break
            top = stack[-1]
            if k == ")":
                top.paren = (f.start, at)
            elif k == "}" and not f.type:
                top.paren = None
                if f.head is not None and f.named or not top.arrows and top.bracket in ("", "{"):
                    top.mark = at + 1
        elif k == ";":
            stop_arrows(top, at)
            top.mark, top.paren, top.pending = at + 1, None, None
        elif k == ",":
            part = code[max(top.mark, at - 500) : at]
            if language == "js" and part.count("<") <= part.count(">") - part.count("=>"):  # not between type parameters
                stop_arrows(top, at)
                top.mark, top.paren = at + 1, None
        elif k == "\n":
            last = code[max(0, at - 200) : at].rstrip()[-1:]
            if language == "go" and top.bracket in ("", "{") and (last.isalnum() or last in "_)]}"):
                top.pending, top.paren, top.mark = None, None, at
            elif top.arrows:
                following = code[at : at + 200].lstrip()[:1]
                if following not in (*".?:&|+-*/%([,=<>{",) and last not in (*"=>(,.?:&|+-*/%<",):
                    stop_arrows(top, at)
                    top.mark, top.paren = at + 1, None
        elif k in ("=>", "->"):
            if k == arrow and not code[t.end() : t.end() + 500].lstrip().startswith("{") and not re.match(r"\s*(?:export\s+)?(?:declare\s+)?type\b", code[top.mark : at]):
                if ext == "java" and re.match(r"\s*(?:case|default)\b", code[begin(top, at) : at]):
                    continue
                head, named = arrow_head(top, at)
                top.arrows = [a for a in top.arrows if a[1] != top.mark]
                if named or not inside():
                    top.arrows.append((head, top.mark))
        elif (language == "js" and k == "function") or (language == "go" and k == "func") or (language == "rs" and k == "fn") or (language == "js" and ext not in JS):
            named = _HEADS[k].match(code, at) is not None or (k == "function" and _BOUND.search(code, max(top.mark, at - 500), at) is not None)
            if k in ("fn", "fun") and not named:
                continue
            top.pending = (begin(top, at), named)
    while stack:
        close(stack.pop(), len(code) - 1)
    return found


def _python_spans(text: str) -> list[tuple[int, int]]:
    """Functions of the syntax tree; by indent where the text doesn't parse."""
    lines = text.split("\n")
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x) + 1)
    tree = [(first, last) for kind, _, first, last, _ in python_facts(text.replace("\r", " ").replace("\f", " ")) if kind == "function"]
    if not tree:
        code = masked(text, "py").split("\n")
        for i, x in enumerate(code):
            m = _DEF.match(x)
            if m:
                last, depth = i, len(m.group(1))
                level = 0
                for j in range(i, len(code)):
                    y = code[j]
                    if j > i and level <= 0 and y.strip() and len(y) - len(y.lstrip()) <= depth:
                        break
                    level += sum(y.count(c) for c in "([{") - sum(y.count(c) for c in ")]}")
                    if y.strip() or lines[j].strip():
                        last = j
                tree.append((i + 1, last + 1))
    return [(at[first - 1], min(at[last], len(text))) for first, last in tree]


def body_spans(path: str, text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lines) of each function. What a named function within it holds is blanked, so each place belongs to its innermost one."""
    text = re.sub("\n\\Z", "", text.removeprefix("\ufeff").replace("\r\n", "\n"))
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("py", "pyi", "rb"):
        spans = _python_spans(text)
    elif ext == "sql":
        spans = [m.span() for m in _SQL.finditer(text)]
    else:
        spans = _brace_spans(text, ext)
    spans = sorted({s for s in spans if s[0] < s[1]}, key=lambda s: (s[0], -s[1]))
    at, line = 0, 1
    for n, (first, last) in enumerate(spans):
        body, done = [], first
        for a, b in spans[n + 1 :]:
            if a >= last:
                break
            if a >= done and b <= last:
                body += [text[done:a], _HIDE.sub(" ", text[a:b])]
                done = b
        line += text.count("\n", at, first)
        at = first
        lines = ("".join(body) + text[done:last]).rstrip("\n").split("\n")
        yield line, line + len(lines) - 1, lines


def function_bodies(files: DataFrame) -> DataFrame:
    """(source, path, start, end, body): each function with its lines."""

    def read(batches):
        for batch in batches:
            paths, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = [(i, *x) for i, (p, t) in enumerate(zip(paths, texts, strict=True)) for x in body_spans(p, t)]
            if rows:
                i, start, end, body = zip(*rows, strict=True)
                cols = [batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(body, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["source", "path", "start", "end", "body"])

    return files.where(F.col("text").isNotNull() & F.col("path").isNotNull()).select("source", "path", "text").mapInArrow(read, "source string, path string, start int, end int, body array<string>")
