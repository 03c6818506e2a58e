"""Clean text out of HTML, Markdown, wiki and LaTeX, with its structure kept.

A value is cut into leaf blocks (elements, fences, environments, formulas, lines)
with the tags and environments around them. A linear-chain conditional random
field over the leaves, with ancestor-tag and text features, says which are
headings, list items, code blocks, formulas or plain text; it is trained at first
use on labelled pages that are put together here, and decoded by Viterbi. Within
headings, items and text the rest of the markup is then found and removed.

Defined results
* Null, empty and markup-free values have no structure; their text is kept.
* CRLF counts as a line feed. Markup that is never closed holds to the end of its
  line, or of the value for code.
* Entities in code are the code's characters. Repeated rows give equal rows;
  empty tables give none. Only the named columns are read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import markup_seeds

LABELS = ("text", "heading", "list", "code_block", "formula")

# --- leaf blocks

_MATH_ENV = "equation|align|gather|displaymath|math|eqnarray|multline"
_ELEMENT = re.compile(
    r"(?P<fence>^[ \t]{0,3}(?P<f>`{3,}|~{3,})[^\n`]*(?:\n(?P<fb>[\s\S]*?))?(?:\n[ \t]{0,3}(?P=f)[`~]*[ \t]*$|\Z))"
    r"|(?P<pre><(?P<p>pre|source|syntaxhighlight|listing|xmp)\b[^>]*>(?P<pb>[\s\S]*?)(?:</(?P=p)\s*>|\Z))"
    r"|(?P<verb>\\begin\{(?P<v>verbatim|Verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\]|\{\w*\})*(?P<vb>[\s\S]*?)(?:\\end\{(?P=v)\*?\}|\Z))"
    r"|(?P<comment><!--[\s\S]*?(?:-->|\Z))"
    r"|(?P<math><math\b[^>]*>(?P<mb>[\s\S]*?)(?:</math\s*>|$)"
    r"|\$\$(?P<m1>[^$]+?)\$\$|\\\[(?P<m2>[\s\S]+?)\\\]|\\\((?P<m3>[^\n]+?)\\\)"
    rf"|\\begin\{{(?P<e>{_MATH_ENV})\*?\}}(?P<m4>[\s\S]*?)(?:\\end\{{(?P=e)\*?\}}|\Z))"
    r"|(?P<dollar>(?<![\\$\w])\$(?P<db>[^$\n]+?)\$(?!\d))"
    r"|(?P<block></?(?P<b>h[1-6]|ul|ol|li|p|div|blockquote|table|tr|td|th|dl|dt|dd|section|article|hr)\b[^<>]*>)",
    re.M | re.I,
)
_MATH_DIV = re.compile(r"<(div|span|p)\b[^>]*class=[\"'][^\"']*math[^\"']*[\"'][^>]*>\s*$", re.I)
_LINE = re.compile(r"[^\n]+")
_ENV = re.compile(r"\\(begin|end)\{(itemize|enumerate|description)\}")


@dataclass
class Leaf:
    start: int
    kind: str  # fence, pre, verb, math, dollar, line
    body: str
    tags: tuple[str, ...]
    whole_line: bool = True


def leaves(value: str) -> tuple[list[Leaf], list[str]]:
    """Leaf blocks in order, and the tags that are neither blocks of their own nor wrap one (p, div, br and such)."""
    out: list[Leaf] = []
    extra: list[str] = []
    tags: list[str] = []

    def lines(a: int, b: int) -> None:
        for m in _LINE.finditer(value, a, b):
            body = m.group()
            if body.strip():
                at_line = m.start() == 0 or value[m.start() - 1] == "\n"
                out.append(Leaf(m.start(), "line", body, tuple(tags), at_line))

    at = 0
    for m in _ELEMENT.finditer(value):
        lines(at, m.start())
        at = m.end()
        kind = m.lastgroup
        kind = next(k for k in ("fence", "pre", "verb", "comment", "math", "dollar", "block") if m[k] is not None)
        if kind == "comment":
            extra.append("comment")
        elif kind == "block":
            name = m["b"].lower()
            if m.group().startswith("</"):
                if name in tags:
                    while tags.pop() != name:
                        pass
            else:
                if name in ("li", "p", "dt", "dd", "tr") and name in tags and not ({"ul", "ol"} & set(tags[len(tags) - tags[::-1].index(name) :])):
                    while tags.pop() != name:
                        pass
                tags.append(name if name != "div" or not _MATH_DIV.search(m.group()) else "mathdiv")
                if name not in ("ul", "ol", "li") and name[0] != "h" and tags[-1] != "mathdiv" or name == "hr":
                    extra.append(name)
                if name == "hr":
                    tags.pop()
            if m.group().startswith("</") and name == "div" and tags and tags[-1] == "mathdiv":
                tags.pop()
        else:
            body = next((m[g] for g in ("fb", "pb", "vb", "mb", "m1", "m2", "m3", "m4", "db") if m[g] is not None), "")
            out.append(Leaf(m.start(), kind, body, tuple(tags), m.start() == 0 or value[m.start() - 1] == "\n"))
    lines(at, len(value))
    return out, extra


# --- features

_PREFIXES = (
    ("hash1", re.compile(r"[ ]{0,3}#(?:\s|$)")),
    ("hashes", re.compile(r"[ ]{0,3}#{2,6}(?:\s|$)")),
    ("equals", re.compile(r"[ ]{0,3}(={1,6})[^=\n].*[^=]\1\s*$")),
    ("underline", re.compile(r"[ ]{0,3}(?:={3,}|-{3,})\s*$")),
    ("dash", re.compile(r"\s*[-+•]\s+\S")),
    ("star", re.compile(r"\s*\*+\s+\S")),
    ("number", re.compile(r"\s*(?:\d{1,3}|[a-z])[.)]\s+\S")),
    ("section", re.compile(r"\s*\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{")),
    ("item", re.compile(r"\s*\\item\b")),
    ("env", re.compile(r"\s*\\(?:begin|end)\{(?:itemize|enumerate|description)\}")),
)
_MATHY = re.compile(r"\\[a-zA-Z]+|[\^_=<>+*/]|\d\s*[-+]\s*\d")
_WORDY = re.compile(r"[A-Za-z가-힣]{3,} [A-Za-z가-힣]{2,} ")


def _prefix(body: str) -> str:
    return next((n for n, p in _PREFIXES if p.match(body)), "none")


def features(value: str, ls: list[Leaf]) -> list[list[str]]:
    pre = [_prefix(x.body) if x.kind == "line" else x.kind for x in ls]
    out = []
    depth = 0
    lead = len(value) - len(value.lstrip())
    for i, x in enumerate(ls):
        f = ["bias", f"kind={x.kind}", f"kind={x.kind},prefix={pre[i]},whole={x.whole_line}"]
        f += [f"in={t[0] if t[0] == 'h' and t != 'hr' else t}" for t in set(x.tags)]
        last = pre[i - 1] if i else "start"
        following = pre[i + 1] if i + 1 < len(ls) else "end"
        if x.kind == "line":
            if x.body.lstrip().startswith("\\end"):
                depth = max(0, depth - len(_ENV.findall(x.body)))
            if depth:
                f.append("in=environment")
            depth += len(re.findall(r"\\begin\{(?:itemize|enumerate|description)\}", x.body)) - (
                0 if x.body.lstrip().startswith("\\end") else len(re.findall(r"\\end\{(?:itemize|enumerate|description)\}", x.body))
            )
            depth = max(0, depth)
            j = x.start
            while j and value[j - 1] in " \t":
                j -= 1
            blank = x.start <= lead or value[max(0, j - 2) : j] == "\n\n"
            after = value[x.start + len(x.body) : x.start + len(x.body) + 3]
            gap = not after.strip(" \t\r") or after.startswith(("\n\n",))
            indented = x.body.startswith(("    ", "\t")) and not x.tags
            f += [f"prefix={pre[i]},gap={blank},{gap}", f"prefix={pre[i]},next={following}", f"prefix={pre[i]},last={last}"]
            if indented:
                f += [f"indented,blank={blank}", f"indented,last={last}", f"indented,prefix={pre[i]}"]
            if following == "underline" and not gap and x.whole_line:
                f.append("underlined")
            if pre[i] == "underline" and not blank:
                f.append("underline of the line above")
        elif x.kind == "dollar":
            b = x.body
            f += [
                f"mathy={bool(_MATHY.search(b))}", f"backslash={chr(92) in b}", f"wordy={bool(_WORDY.search(b))}",
                f"blank inside={b[:1].isspace()},{b[-1:].isspace()}", f"upper name={bool(re.match(r'[A-Z]{2,}', b))}", f"amount={bool(re.match(r'[0-9]', b))}",
            ]
        out.append(f)
    return out


# --- the field


class ChainField:
    """Linear-chain CRF over sparse binary features, fitted by gradient steps on the log-likelihood."""

    def __init__(self, labels: int) -> None:
        self.n = labels
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, labels))
        self.trans = np.zeros((labels, labels))

    def _ids(self, feats: list[list[str]]) -> list[list[int]]:
        return [[self.index[f] for f in fs if f in self.index] for fs in feats]

    def _unary(self, ids: list[list[int]]) -> np.ndarray:
        return np.array([self.w[i].sum(0) for i in ids])

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int, rate: float, decay: float) -> None:
        for feats, _ in pages:
            for fs in feats:
                for f in fs:
                    self.index.setdefault(f, len(self.index))
        self.w = np.zeros((len(self.index), self.n))
        g2, t2 = np.full_like(self.w, 1e-2), np.full_like(self.trans, 1e-2)
        data = [(self._ids(f), np.array(y)) for f, y in pages if y]
        rng = random.Random(7)
        for _ in range(epochs):
            rng.shuffle(data)
            for ids, y in data:
                u = self._unary(ids)
                k = len(y)
                a, b = np.empty_like(u), np.zeros_like(u)
                a[0] = u[0]
                for t in range(1, k):
                    x = a[t - 1][:, None] + self.trans
                    m = x.max(0)
                    a[t] = u[t] + m + np.log(np.exp(x - m).sum(0))
                for t in range(k - 2, -1, -1):
                    x = self.trans + (u[t + 1] + b[t + 1])[None, :]
                    m = x.max(1)
                    b[t] = m + np.log(np.exp(x - m[:, None]).sum(1))
                z = a[-1].max() + np.log(np.exp(a[-1] - a[-1].max()).sum())
                p = np.exp(a + b - z)
                p[np.arange(k), y] -= 1
                for t, i in enumerate(ids):
                    g = p[t][None, :] + decay * self.w[i]
                    g2[i] += g * g
                    self.w[i] -= rate * g / np.sqrt(g2[i])
                if k > 1:
                    g = np.zeros_like(self.trans)
                    for t in range(1, k):
                        g += np.exp(a[t - 1][:, None] + self.trans + (u[t] + b[t])[None, :] - z)
                        g[y[t - 1], y[t]] -= 1
                    t2 += g * g
                    self.trans -= rate * g / np.sqrt(t2)

    def decode(self, feats: list[list[str]]) -> list[int]:
        u = self._unary(self._ids(feats))
        back = []
        score = u[0]
        for t in range(1, len(u)):
            x = score[:, None] + self.trans
            back.append(x.argmax(0))
            score = u[t] + x.max(0)
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


# --- labelled pages

def _page(rng: random.Random) -> list[tuple[str, str]]:
    """(piece, label): the pieces of a labelled page, in order."""
    dialect = rng.choice(("html", "md", "md", "wiki", "tex"))
    one = lambda: rng.choice(markup_seeds.SENTENCES)
    short = lambda: " ".join(one().split()[: rng.randint(2, 5)])
    code = lambda: "\n".join(rng.choice(markup_seeds.CODE_LINES) for _ in range(rng.randint(1, 3)))
    form = lambda: rng.choice(markup_seeds.FORMULAS)
    out: list[tuple[str, str]] = []

    def para() -> None:
        n = rng.randint(1, 3)
        text = " ".join(rng.choice(markup_seeds.ALIKE) if rng.random() < 0.25 else one() for _ in range(n))
        if dialect == "html" and rng.random() < 0.5:
            text = f"<p>{text}" + rng.choice(("</p>", ""))
        if rng.random() < 0.2 and dialect in ("md", "tex"):
            out.extend([("Here ", "text"), (f"${form()}$", "formula"), (f" holds. {text}", "text")])
        else:
            out.append((text, "text"))

    def heading() -> None:
        h = short()
        n = rng.randint(1, 4)
        if dialect == "html":
            tag = rng.choice(("h", "H")) + str(n)
            out.append((f"<{tag}{rng.choice(('', ' id=x'))}>{h}</{tag}>", "heading"))
        elif dialect == "md":
            out.append((rng.choice((f"{'#' * n} {h}", f"{'#' * n} {h} {'#' * n}", f"{h}\n========", f"{h}\n--------")), "heading"))
        elif dialect == "wiki":
            out.append((f"{'=' * (n + 1)} {h} {'=' * (n + 1)}", "heading"))
        else:
            out.append((f"\\{rng.choice(('section', 'subsection', 'subsection*', 'paragraph'))}{{{h}}}", "heading"))

    def items() -> None:
        n = rng.randint(2, 5)
        if dialect == "html":
            t, sep = rng.choice(("ul", "ol")), rng.choice(("", "\n"))
            close = rng.choice(("</li>", "</li>", ""))
            out.append((f"<{t}>" + sep.join(f"<li>{one()}{close}" for _ in range(n)) + f"</{t}>", "list"))
        elif dialect == "md":
            mark = rng.choice(("-", "*", "+", "1."))
            out.append(("\n".join(("  " if i and rng.random() < 0.15 else "") + f"{mark} {one()}" for i in range(n)), "list"))
        elif dialect == "wiki":
            mark = rng.choice("*#")
            out.append(("\n".join(mark * (1 + (i > 0 and rng.random() < 0.3)) + f" {one()}" for i in range(n)), "list"))
        else:
            e = rng.choice(("itemize", "enumerate"))
            out.append((f"\\begin{{{e}}}\n" + "\n".join(f"  \\item {one()}" for _ in range(n)) + f"\n\\end{{{e}}}", "list"))

    def block() -> None:
        c = code()
        if dialect == "html":
            out.append((rng.choice((f"<pre>{c}</pre>", f"<pre><code>{html.escape(c)}</code></pre>")), "code_block"))
        elif dialect == "md":
            f = rng.choice(("```", "~~~", "```ts"))
            out.append((rng.choice((f"{f}\n{c}\n{f[:3]}", "\n".join(f"    {x}" for x in c.split("\n")))), "code_block"))
        elif dialect == "wiki":
            t = rng.choice(("source", "syntaxhighlight"))
            out.append((f'<{t} lang="ts">\n{c}\n</{t}>', "code_block"))
        else:
            e = rng.choice(("verbatim", "lstlisting"))
            out.append((f"\\begin{{{e}}}\n{c}\n\\end{{{e}}}", "code_block"))

    def formula() -> None:
        x = form()
        if dialect == "html":
            out.append((rng.choice((f'<div class="math">\\[{x}\\]</div>', f"<math>{x}</math>")), "formula"))
        elif dialect == "wiki":
            out.append((f"<math>{x}</math>", "formula"))
        else:
            out.append((rng.choice((f"$${x}$$", f"$$\n{x}\n$$", f"\\[ {x} \\]", f"\\begin{{equation}}\n{x}\n\\end{{equation}}")), "formula"))

    parts = [p for p in (heading, para, items, block, formula, para) if rng.random() < 0.5] or [para]
    if rng.random() < 0.2:
        rng.shuffle(parts)
    for i, p in enumerate(parts):
        if i:
            out.append(("\n\n", "text"))
        p()
    return out


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[Leaf], list[int]]]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        pieces = _page(rng)
        value = "".join(p for p, _ in pieces)
        marks = np.repeat([LABELS.index(x) for _, x in pieces], [len(p) for p, _ in pieces])
        ls, _ = leaves(value)
        out.append((value, ls, [int(marks[x.start + len(x.body) - len(x.body.lstrip())]) if x.kind == "line" else int(marks[x.start]) for x in ls]))
    return out


@cache
def trained(pages: int = 500, epochs: int = 6, seed: int = 11) -> ChainField:
    field = ChainField(len(LABELS))
    field.fit([(features(v, ls), y) for v, ls, y in labelled_pages(pages, seed)], epochs, 0.3, 1e-3)
    return field


# --- the rest of the markup

_TAGS = (
    "a abbr acronym address article aside audio b big blockquote br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "figure figcaption font footer form header hr i iframe img input ins kbd label link main mark nav nowiki p picture q ref references s samp script section "
    "small span strike strong style sub summary sup table tbody td tfoot th thead tr tt u var video wbr gallery includeonly noinclude onlyinclude"
).split()
_INLINE = {
    "tag": re.compile(rf"</?(?:{'|'.join(_TAGS)})(?:\s[^<>]*)?/?>", re.I),
    "entity": re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});"),
    "image": re.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)"),
    "link": re.compile(r"(?<!!)\[([^\[\]\n]+)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\[[^\]\n]*\])"),
    "autolink": re.compile(r"<((?:https?|mailto):[^<>\s]+)>"),
    "footnote": re.compile(r"\[\^[^\]\s]+\]|\[@[^\]\n]+\]"),
    "template": re.compile(r"\{\{([^{}\n]*)\}\}"),
    "wikilink": re.compile(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]*)\]\]"),
    "extlink": re.compile(r"\[(?:https?:)?//[^\s\]]+(?:\s+([^\]\n]*))?\]"),
    "wikibold": re.compile(r"'''''(?=\S)([^\n]+?)'''''|'''(?=\S)([^\n]+?)'''|''(?=[^\s'])([^\n]+?)(?<=[^\s'])''"),
    "command": re.compile(r"~?\\(?!(?:begin|end|item|(?:sub)*section|(?:sub)?paragraph|chapter|part)\b)[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*\{([^{}\n]*)\}"),
    "code": re.compile(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)"),
    "strike": re.compile(r"~~(?=\S)([^\n]+?)(?<=\S)~~"),
    "bold": re.compile(r"\*\*(?=[^\s*/.])([^\n]+?)(?<=[^\s*])\*\*(?!\w)|(?<!\w)__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?!\w)"),
    "emphasis": re.compile(r"(?<![\w*\\/])\*(?=[^\s*/.])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?!\w)"),
    "quote": re.compile(r"^[ ]{0,3}>\s+\S"),
    "rule": re.compile(r"^[ ]{0,3}(?:-{3,}|\*{3,}|_{3,}|(?:- ){2,}-|(?:\* ){2,}\*)\s*$"),
    "table": re.compile(r"^\s*\|.*\|\s*$|^\s*\{\||^\s*\|\}"),
}
#: names of the Python data model, which stand between underscores without emphasis
_DUNDERS = set("init main name file doc str repr call len iter next enter exit new del eq hash all dict class slots version path proto dirname filename getitem setitem contains".split())
_HINT = re.compile(r"[<\\`#*_=~\[{&$|>]|''|^\s*[-+•]\s|^\s*\w{1,3}[.)]\s|^ {4}|^\t|^-{3}", re.M)
_BUILDERS = re.compile(r"</?(?:h[1-6]|ul|ol|li|pre|math|m[a-z]+|source|syntaxhighlight)\b[^<>]*>", re.I)


def _is_markup(name: str, m: re.Match) -> bool:
    if name == "bold" and m[2] is not None and m[2] in _DUNDERS:
        return False
    if name == "tag" and not re.search(r"[\s/]", m.group()[1:-1]) and m.start() and m.string[m.start() - 1].isascii():
        # a generic type looks like a tag behind a name; a tag there is closed further on
        if m.string[m.start() - 1].isalnum() and f"</{m.group()[1:-1]}" not in m.string[m.end() :] and m.group()[1:-1].lower() not in ("br", "wbr"):
            return False
    if name == "entity":
        return html.unescape(m.group()) != m.group()
    return True


def _residue(body: str) -> bool:
    return any(_is_markup(n, m) for n, p in _INLINE.items() for m in p.finditer(body))


def _plain(body: str) -> str:
    """Text of a leaf without its inline markup."""

    def inner(name: str):
        def sub(m: re.Match) -> str:
            if not _is_markup(name, m):
                return m.group()
            if name in ("tag", "footnote"):
                return "\n" if m.group().lower().startswith("<br") else ""
            if name == "entity":
                return html.unescape(m.group())
            if name == "code":
                return m[2]
            if name == "template":
                return m[1].split("|")[-1]
            if name == "command" and re.match(r"~?\\(?:cite|ref|label)", m.group()):
                return ""
            if name == "quote":
                return m.group().lstrip(" >")
            if name in ("rule", "table"):
                return m.group().strip(" |-*_{}")
            return next((g for g in m.groups() if g is not None), "")

        return sub

    for name, p in _INLINE.items():
        if name != "entity":
            body = p.sub(inner(name), body)
    return _INLINE["entity"].sub(inner("entity"), _BUILDERS.sub("", body))


def parsed(value: str, field: ChainField | None = None) -> tuple[list[tuple[Leaf, str]], list[str]]:
    """Labelled leaves, and the marks outside of them."""
    value = value.replace("\r\n", "\n").replace("\r", "\n")
    ls, extra = leaves(value)
    if not ls:
        return [], extra
    return list(zip(ls, (LABELS[y] for y in (field or trained()).decode(features(value, ls))), strict=True)), extra


def structures(value: str | None, field: ChainField | None = None) -> list[str]:
    """Which of heading, list, code_block, formula and other a value holds as markup."""
    if not value or not _HINT.search(value):
        return []
    labelled, extra = parsed(value, field)
    found = {y for _, y in labelled if y != "text"}
    if extra or any(y in ("text", "heading", "list") and _residue(x.body) for x, y in labelled if x.kind == "line" and not _is_underline(x.body, y)):
        found.add("other")
    return sorted(found)


def _is_underline(body: str, label: str) -> bool:
    return label == "heading" and bool(_PREFIXES[3][1].match(body))


_MARK = re.compile(r"^\s*(?:#{1,6}\s+|[-+•]\s+|\*+\s+|\d{1,3}[.)]\s+|\\item\s*)")


def clean(value: str | None, field: ChainField | None = None) -> str | None:
    """The text of a value in one plain notation: `#` headings, `-` items, fenced code, `$` formulas."""
    if value is None:
        return None
    if not _HINT.search(value):
        return value
    labelled, _ = parsed(value, field)
    out: list[str] = []
    last: tuple[str, bool] = ("", True)
    for x, y in labelled:
        if y == "code_block":
            body = html.unescape(re.sub(r"</?code[^>]*>", "", x.body)) if x.kind == "pre" else x.body
            if x.kind == "line":
                body = re.sub(r"^(?: {4}|\t)", "", x.body)
                if last == ("code line", True):
                    out[-1] = out[-1][:-3] + body + "\n```"
                    continue
            out.append("```\n" + body.strip("\n") + "\n```")
            last = ("code line", x.kind == "line")
            continue
        if y == "formula":
            piece = "$" + re.sub(r"<[^>]+>", "", x.body).strip() + "$"
        elif y == "heading":
            if _is_underline(x.body, y):
                continue
            body = re.sub(r"^\s*#+\s*|\s*#+\s*$|^\s*=+\s*|\s*=+\s*$", "", x.body)
            body = re.sub(r"^\s*\\\w+\*?(?:\[[^\]]*\])?\{(.*)\}\s*$", r"\1", body)
            piece = "# " + _plain(body).strip()
        elif y == "list":
            if _PREFIXES[9][1].match(x.body):
                continue
            body = x.body
            while _MARK.match(body):
                body = _MARK.sub("", body, count=1)
            piece = "- " + _plain(body.lstrip("#* ")).strip()
        else:
            piece = _plain(x.body).strip()
        if not piece.strip("-# "):
            continue
        if not x.whole_line and out and last[0] in ("text", "formula") and y in ("text", "formula"):
            out[-1] += ("" if out[-1].endswith("\n") else " ") + piece
        else:
            out.append(piece)
        last = (y, False)
    return "\n".join(out)


def found_structures(values: DataFrame) -> DataFrame:
    """(origin, row_id, field, structure) of rows (origin, row_id, field, value)."""
    model = trained()  # trained once, on the driver; a few thousand numbers

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, v in enumerate(batch.column(3).to_pylist()):
                for s in structures(v, model):
                    at.append(i)
                    out.append(s)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(rows) for j in range(3)), pa.array(out, pa.string())], names=["origin", "row_id", "field", "structure"])

    return (
        values.where(F.col("value").isNotNull())
        .select("origin", "row_id", "field", "value")
        .mapInArrow(find, "origin string, row_id bigint, field string, structure string")
    )


def cleaned(values: DataFrame) -> DataFrame:
    """The rows with `clean` in place of the value."""
    model = trained()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(v, model) for v in batch.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(3)), texts], names=["origin", "row_id", "field", "clean"])

    return values.select("origin", "row_id", "field", "value").mapInArrow(find, "origin string, row_id bigint, field string, clean string")
