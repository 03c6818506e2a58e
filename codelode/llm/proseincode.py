"""Natural language inside source files.

A character-level hidden Markov model with one code state and one state per
language segments each whole file: states emit a character given the two before
it, with probabilities fitted from short seed texts, and a change of language
passes through the code state, at a lower cost in comments and literals than
outside of them. Viterbi runs over many files at once, one array step per
character position. Its spans are then restricted to the file's comments and
string literals: a passage counts if enough of it lies in language states and
holds a phrase, and its language is the one whose states have most of its letters.

Defined results
* Null and empty texts give no passage. Files of an unknown kind are read like C.
* Byte-order marks and CRLF change neither lines nor passages.
* An unterminated literal ends with its line, an unterminated comment or raw
  literal with the file.
* Repeated rows give equal rows. Empty tables give none. Only the named columns
  are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import seeds

STATES = ("code", "en", "ko", "ja", "zh", "de", "es", "fr")
_LATIN, _SCRIPTS = (1, 5, 6, 7), (2, 3, 4)
#: cost of a change between code and a language, in comments and literals and outside of them
INSIDE, OUTSIDE = np.float32(4.0), np.float32(12.0)
#: what entering a language costs besides; of the Latin scripts English is what source files mostly hold
RARER = np.array([0, 0, 0, 0, 2, 2, 2], np.float32)
MIN_WORDS, MIN_CJK = 3, 6
SPOKEN = 0.4  # share of a passage's letters that the language states must cover
LETTER = 2.5  # letters of a Latin script that one of ko, ja, zh stands for
PIECE, MARGIN = 1536, 160
_CHARS = 1 << 20  # characters segmented at once

# --- character classes: ASCII as it is, accented letters by themselves, scripts as one each
_ACCENTED = "äöüßéèêëàâçñíóúáïîôûùœæÄÖÜÉÈÊÀÂÇÑÍÓÚÁ¿¡«»“”‘’–—…°"
_HANGUL, _HIRAGANA, _KATAKANA, _HAN, _WIDE, _OTHER = range(128 + len(_ACCENTED), 134 + len(_ACCENTED))
_CLASSES = _OTHER + 1


@cache
def _class_table() -> np.ndarray:
    t = np.full(0x10000, _OTHER, np.uint8)
    t[:128] = np.arange(128)
    t[ord("A") : ord("Z") + 1] = np.arange(ord("A"), ord("Z") + 1)
    for i, c in enumerate(_ACCENTED):
        t[ord(c)] = 128 + i
    for lo, hi, k in (
        (0xAC00, 0xD7A3, _HANGUL), (0x1100, 0x11FF, _HANGUL), (0x3130, 0x318F, _HANGUL), (0x3041, 0x309F, _HIRAGANA),
        (0x30A0, 0x30FF, _KATAKANA), (0x4E00, 0x9FFF, _HAN), (0x3400, 0x4DBF, _HAN), (0x3000, 0x303F, _WIDE), (0xFF00, 0xFFEF, _WIDE),
    ):
        t[lo : hi + 1] = k
    return t


def _codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _class_table()[np.minimum(cp, 0xFFFF)]


@cache
def _folded() -> np.ndarray:
    """Class of a character as context: letters without case, digits, accents and rare signs together."""
    low = "\n abcdefghijklmnopqrstuvwxyzäöüßéèêàçñóíáú0.,'\"()_-/"
    t = np.full(_CLASSES, len(low), np.int64)
    t[128:_HANGUL] = len(low) + 1
    for c in range(128):
        ch = "0" if chr(c).isdigit() else " " if chr(c) == "\t" else chr(c).lower()
        if ch in low:
            t[c] = low.index(ch)
    for i, c in enumerate(_ACCENTED):
        if c.lower() in low:
            t[128 + i] = low.index(c.lower())
    t[[_HANGUL, _HIRAGANA, _KATAKANA, _HAN, _WIDE]] = np.arange(5) + len(low) + 2
    return t


def _contexts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded classes of the character before each one, and of that before it; line feeds stand before a text."""
    f = np.concatenate([[0, 0], _folded()[code]])
    return f[1:-1], f[:-2]


@cache
def emissions() -> np.ndarray:
    """log P(character | the two before it, state), one row per state, one column per triple of classes."""
    n = int(_folded().max()) + 1
    out = np.empty((len(STATES), n * n * _CLASSES), np.float32)
    for i, name in enumerate(STATES):
        code = _codes(getattr(seeds, name.upper()))
        uni = np.bincount(code, minlength=_CLASSES).astype(float)
        # what a text of the language may hold without the seed holding it
        uni += 0.02
        if name != "code":
            uni[ord("A") : ord("Z") + 1] += 1.0
            uni[ord("0") : ord("9") + 1] += 1.5
            uni[[ord(c) for c in "-_/.{}"]] += 1.0
        uni /= uni.sum()
        one, two = _contexts(code)
        pairs = np.zeros((n, _CLASSES))
        np.add.at(pairs, (one, code), 1)
        pairs = (pairs + 4 * uni) / (pairs.sum(1, keepdims=True) + 4)
        triples = np.zeros((n, n, _CLASSES))
        np.add.at(triples, (two, one, code), 1)
        triples = (triples + 3 * pairs[None]) / (triples.sum(2, keepdims=True) + 3)
        out[i] = np.log(triples).ravel()
    return out


def _columns(code: np.ndarray) -> np.ndarray:
    """Column of the emission table at each character."""
    one, two = _contexts(code)
    return ((two * (int(_folded().max()) + 1) + one) * _CLASSES + code).astype(np.int32)


_START = np.array([0.0] + [-OUTSIDE] * (len(STATES) - 1), np.float32)


def _viterbi(columns: list[np.ndarray], inside: list[np.ndarray], before: list[np.ndarray], final: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Scores before each character and behind the last, and the state of each character.

    One column a text, all padded to the longest; a text's path starts at its own
    end, from the best state or the one given.
    """
    table = emissions()
    n, size = len(columns), np.array([len(c) for c in columns])
    steps = int(size.max())
    pair, cost = np.zeros((n, steps), np.int32), np.full((n, steps), OUTSIDE, np.float32)
    for j, (c, x) in enumerate(zip(columns, inside, strict=True)):
        pair[j, : len(c)] = c
        cost[j, : len(c)][x] = INSIDE
    pair, cost = np.ascontiguousarray(pair.T), np.ascontiguousarray(cost.T)
    scores = np.empty((steps + 1, len(STATES), n), np.float32)
    scores[0] = np.stack(before, axis=1)
    entered = np.empty((steps, len(STATES) - 1, n), bool)  # a language state came from code
    left = np.empty((steps, n), bool)  # code came from a language
    rarer = RARER[:, None]
    spoken, code, emitted = np.empty(n, np.float32), np.empty(n, np.float32), np.empty((len(STATES), n), np.float32)
    for t in range(steps):
        old, new = scores[t], scores[t + 1]
        np.subtract(old[0], cost[t], out=code)
        np.subtract(code, rarer, out=emitted[1:])
        np.greater(emitted[1:], old[1:], out=entered[t])
        np.maximum(old[1:], emitted[1:], out=new[1:])
        np.maximum.reduce(old[1:], axis=0, out=spoken)
        spoken -= cost[t]
        np.greater(spoken, old[0], out=left[t])
        np.maximum(spoken, old[0], out=new[0])
        np.take(table, pair[t], axis=1, out=emitted, mode="clip")
        new += emitted
    path = np.zeros((steps, n), np.int8)
    cols = np.arange(n)
    ends: dict[int, list[int]] = {}
    for j, k in enumerate(size.tolist()):
        ends.setdefault(k - 1, []).append(j)
    now = np.zeros(n, np.int64)
    for t in range(steps - 1, -1, -1):
        for j in ends.get(t, ()):
            now[j] = int(scores[t + 1, :, j].argmax()) if final[j] is None else final[j]
        path[t] = now
        in_code = now == 0
        back = np.where(in_code, False, entered[t][now - 1, cols])
        to_language = np.flatnonzero(in_code & left[t])
        now = np.where(back, 0, now)
        if len(to_language):
            now[to_language] = scores[t, 1:, to_language].argmax(1) + 1
    return scores, path


def _level(v: np.ndarray) -> np.ndarray:
    return v - v.max()


@dataclass
class _Piece:
    """A stretch of a text and what Viterbi says of it; `ahead` is the state of the character behind it."""

    at: int
    to: int
    path: np.ndarray | None = None
    first: np.ndarray | None = None  # scores before its first character
    last: np.ndarray | None = None  # scores behind its last
    ahead: int = 0


def segment(texts: list[str], spans: list[list[tuple[int, int]]] | None = None) -> list[np.ndarray]:
    """State of each character of each text, as Viterbi over the whole text gives it.

    `spans` are the comments and literals, in which a change of state costs less.
    Long texts go through in pieces, each with MARGIN characters more on either
    side, in which the surviving paths mostly merge. Whether they did is checked at
    each border, in order: where the scores a piece starts from aren't those the
    piece before ends with, it is decoded again from those; where the state its path
    ends in isn't the one the next piece starts in, again back from that. So the
    result is that of one run.
    """
    codes = [_columns(_codes(t)) for t in texts]
    inside = [np.zeros(len(c), bool) for c in codes]
    for x, own in zip(inside, spans or [[(0, len(c))] for c in codes], strict=True):
        for s, e in own:
            x[s : e + 1] = True
    pieces = [[_Piece(at, min(len(c), at + PIECE)) for at in range(0, len(c), PIECE)] for c in codes]
    todo = [(i, p) for i, own in enumerate(pieces) for p in own]
    reach = [(max(0, p.at - MARGIN), min(len(codes[i]), p.to + MARGIN)) for i, p in todo]
    order = sorted(range(len(todo)), key=lambda j: reach[j][1] - reach[j][0])
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (reach[order[hi]][1] - reach[order[hi]][0]) <= _CHARS:
            hi += 1
        part = [(todo[j], reach[j]) for j in order[lo:hi]]
        scores, path = _viterbi(
            [codes[i][a:b] for (i, _), (a, b) in part], [inside[i][a:b] for (i, _), (a, b) in part],
            [_START if a == 0 else np.zeros_like(_START) for _, (a, _) in part], [None] * len(part),
        )
        for col, ((i, p), (a, _)) in enumerate(part):
            p.path = path[p.at - a : p.to - a, col].copy()
            p.first, p.last = _level(scores[p.at - a, :, col]), _level(scores[p.to - a, :, col])
            p.ahead = int(path[p.to - a, col]) if p.to < len(codes[i]) else -1
        lo = hi
    for i, own in enumerate(pieces):
        for p, q in zip(own, own[1:], strict=False):
            if np.abs(p.last - q.first).max() > 1e-2:
                b = min(len(codes[i]), q.to + MARGIN)
                scores, path = _viterbi([codes[i][q.at : b]], [inside[i][q.at : b]], [p.last], [None])
                n = q.to - q.at
                q.path, q.first, q.last = path[:n, 0].copy(), p.last, _level(scores[n, :, 0])
                q.ahead = int(path[n, 0]) if q.to < len(codes[i]) else -1
        for p, q in zip(own[-2::-1], own[:0:-1], strict=False):
            if p.ahead != q.path[0]:
                b = p.to + 1
                _, path = _viterbi([codes[i][p.at : b]], [inside[i][p.at : b]], [p.first], [int(q.path[0])])
                p.path = path[: p.to - p.at, 0].copy()
    return [np.concatenate([p.path for p in own]) if own else np.zeros(0, np.int8) for own in pieces]


# --- comments and literals

_DQ = r'"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z)"
_BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
_CHAR = r"'(?:\\(?:u\{[^}\n]*\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[^\n])|[^'\\\n])'"
_LEXERS = {
    "js": rf"(?P<line>//[^\n]*)|(?P<block>{_BLOCK})|(?P<tpl>`(?:[^`\\$]|\\[\s\S]|\$(?:\{{(?:[^{{}}`]|`(?:[^`\\]|\\[\s\S])*`|\{{[^{{}}]*\}})*\}})?)*(?:`|\Z))"
    rf"|(?P<str>{_DQ}|{_SQ})|(?P<skip>[=(,:\[!&|?;{{]\s*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)",
    "java": rf'(?P<line>//[^\n]*)|(?P<block>{_BLOCK})|(?P<tri>"""[\s\S]*?(?:(?<!\\)"""|\Z))|(?P<str>{_DQ})|(?P<skip>{_CHAR})',
    "go": rf"(?P<line>//[^\n]*)|(?P<block>{_BLOCK})|(?P<raw>`[^`]*(?:`|\Z))|(?P<str>{_DQ})|(?P<skip>{_CHAR})",
    "rs": r'(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?(?:\*/|\Z))|(?P<raw>\bb?r(?P<h>#*)"[\s\S]*?(?:"(?P=h)|\Z))'
    rf'|(?P<str>"(?:[^"\\]|\\[\s\S])*(?:"|\Z))|(?P<skip>{_CHAR})',
    "py": r"(?P<line>#[^\n]*)|(?P<tri>(?P<p>\b[rRbBuUfF]{1,2})?(?:'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)"
    r'|"""(?:[^\\]|\\[\s\S])*?(?:"""|\Z)))' + rf"|(?P<str>{_DQ}|{_SQ})",
    "sql": rf"(?P<line>(?:--|//)[^\n]*)|(?P<block>{_BLOCK})|(?P<sq>'(?:[^']|'')*(?:'|\Z))|(?P<skip>\"[^\"\n]*\")",
}
_KIND = {"ts": "js", "tsx": "js", "js": "js", "mjs": "js", "jsx": "js", "cjs": "js", "java": "java", "go": "go", "rs": "rs", "py": "py", "sql": "sql"}


@cache
def _lexer(kind: str) -> re.Pattern:
    return re.compile(_LEXERS[kind])


_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|U([0-9a-fA-F]{8})|\r?\n[ \t]*|([\s\S]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3] or m[4]
    if code:
        n = int(code, 16)
        return chr(n) if n < 0x110000 else "�"
    return _SIMPLE.get(m[5], m[5]) if m[5] else ""


_CODED = re.compile(r"\\[uUx]")


def resolved(text: str) -> str:
    if "\\" not in text:
        return text
    s = _ESCAPE.sub(_unescape, text)
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_LEADER = {"py": re.compile(r"^#+!?[ \t]?"), "sql": re.compile(r"^(?:--+|//+)[ \t]?")}
_SLASHES = re.compile(r"^//[/!]*[ \t]?")
_STAR = re.compile(r"^[ \t]*\*+(?!/)[ \t]?", re.M)
_NEWLINE = re.compile("\n")


def passages(text: str, kind: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, origin, inner text) of each comment, run of line comments, and literal."""
    leader = _LEADER.get(kind, _SLASHES)
    run: list[str] = []
    run_alone = True
    start = end = -1
    for m in _lexer(kind).finditer(text):
        group = m.lastgroup
        if group in ("h", "p"):
            group = "raw" if kind == "rs" else "tri"
        if group == "line":
            s, e = m.span()
            own = leader.sub("", m.group().rstrip("\r"))
            alone = not text[text.rfind("\n", 0, s) + 1 : s].strip("\ufeff \t")
            # what stands behind code is a passage of its own
            if run and alone and run_alone and text.count("\n", end, s) == 1 and not text[end:s].strip():
                run.append(own)
            else:
                if run:
                    yield start, end, "comment", "\n".join(run)
                run, start, run_alone = [own], s, alone
            end = e
            continue
        if group == "skip":
            continue
        s, e = m.span()
        token = m.group()
        if group == "block":
            yield s, e, "comment", _STAR.sub("", token[2:].removesuffix("*/"))
        elif group == "sq":
            yield s, e, "literal", token.strip("'").replace("''", "'")
        elif group == "tri":
            cut = token.find(token[-1] * 3) if token[-3:] in ('"""', "'''") else 0
            yield s, e, "literal", resolved(token[cut + 3 : -3])
        elif group == "raw":
            yield s, e, "literal", token[token.find('"') + 1 : token.rfind('"')] if kind == "rs" else token.strip("`")
        else:
            closed = len(token) > 1 and token[-1] == token[0]
            yield s, e, "literal", resolved(token[1:-1] if closed else token[1:])
    if run:
        yield start, end, "comment", "\n".join(run)


# --- which passages are prose

_CJK = re.compile("[가-힣ᄀ-ᇿ㄰-㆏ぁ-ゟ゠-ヿ㐀-鿿]")
_HANGUL_RE, _KANA_RE = re.compile("[가-힣ᄀ-ᇿ㄰-㆏]"), re.compile("[ぁ-ゟァ-ヺ]")
#: what stands in prose without being prose and without blanks around it
_INSERTED = re.compile(r"<!?/?[A-Za-z][^<>\n]*>|\$?\{[^{}\n]*\}|&\w+;|^[ \t]*@\w+[^\n]*$", re.M)
_NOT_PROSE = re.compile(
    r"^\s*\W*(?:eslint|istanbul|c8 ignore|v8 ignore|noqa|pylint|pyright|mypy|type:|fmt:|isort|flake8|ruff|nosec|nolint|go:|@ts-|ts-|tslint|prettier|jshint|jslint|biome|stylelint|"
    r"webpack|sourceMappingURL|SPDX|Copyright\b|\(c\)|©|Licensed under|All rights reserved|region\b|endregion|#\w|pragma|language=|noinspection|rustfmt|clippy|cspell|spell-?checker|"
    r"coding[:=]|-\*-|vim:|\+migrate|\+goose|\+build|!\d{5}|sqlfluff|NOSONAR|CHECKSTYLE|SuppressWarnings|"
    r"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|GRANT|REVOKE|WITH|MERGE|TRUNCATE|SET)\s+[\w*\"`(])"
)
#: names, paths, keys and numbers, which say nothing of a passage's language
_NAME = re.compile(r"\S*(?:[a-z][A-Z]|[_/{}\d])\S*")
_CODE_HINT = re.compile(r"[;={]|\w\(")
_CODE_LINE = re.compile(
    r"[;{}]\s*$|(?:^|\s)(?:=|==|===|:=|=>|->|\+=|&&|\|\||!=|<=|>=)(?:\s|$)|^\s*[\w.]+\([^()]*\)\s*$|^\s*(?:import|from|return|const|let|var|def|func|fn)\s[^.!?]*[;:{(]\s*$"
)


def _spoken_words(text: str) -> list[str]:
    """Lower-case words that are no names, paths, keys or numbers."""
    out = []
    for token in text.split():
        w = token.strip(".,;:!?()[]\"'`«»“”‘’…*_—–-¿¡")
        plain = w if w.isalpha() else w.replace("'", "").replace("’", "").replace("-", "")
        if plain.isalpha() and (plain.islower() or plain[1:].islower() or len(plain) == 1):
            out.append(w.lower())
    return out


def judge(inner: str, raw: str, states: np.ndarray) -> str | None:
    """The language of a passage, or None if it is no prose.

    `raw` is the passage as it stands in the file, `states` those of its characters.
    Each letter counts for the language whose state it has; one of ko, ja and zh
    stands for several of a Latin script.
    """
    lines = [x for x in inner.split("\n") if not _NOT_PROSE.match(x)]
    inner = "\n".join(lines)
    counts = np.bincount(states, minlength=len(STATES)).astype(float)
    own = 0 if inner.isascii() else len(_CJK.findall(inner))
    if own >= MIN_CJK:
        letters = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32)
        wide = (letters >= 0x1100) & _script()[np.minimum(letters, 0xFFFF)]
        by = np.bincount(states[wide], minlength=len(STATES))
        best = max(_SCRIPTS, key=by.__getitem__)
        # the model must take them for words of a language, and they must outweigh words of another
        if by[best] >= MIN_CJK and by[best] >= SPOKEN * wide.sum() and by[best] * LETTER >= max(counts[i] for i in _LATIN):
            return STATES[best]
    if "<" in inner or "{" in inner or "&" in inner or "@" in inner:
        inner = _INSERTED.sub(" ", inner)
        lines = inner.split("\n")
    if _CODE_HINT.search(inner):
        lines = [x for x in lines if not _CODE_LINE.search(x)]
    ws = _spoken_words(" ".join(lines))
    if len(ws) < MIN_WORDS:
        return None
    heard = [i for i in _LATIN if counts[i]]
    spoken = counts[heard].sum()
    if not heard or spoken < SPOKEN * min(counts.sum(), 1.4 * sum(len(w) + 1 for w in ws)):
        return None
    if len(heard) > 1:  # one language a passage: the one that all of its spoken letters are likeliest in
        heeded = np.isin(states, heard)
        for m in _NAME.finditer(raw):
            heeded[m.start() : m.end()] = False
        columns = _columns(_codes(raw))[heeded]
        return STATES[max(heard, key=lambda i: emissions()[i, columns].sum() - RARER[i - 1])]
    return STATES[heard[0]]


@cache
def _script() -> np.ndarray:
    """Which characters are letters of ko, ja or zh."""
    t = _class_table()
    return (t == _HANGUL) | (t == _HIRAGANA) | (t == _KATAKANA) | (t == _HAN)


def kind_of(path: str | None) -> str:
    return _KIND.get(path.rsplit(".", 1)[-1].lower() if path and "." in path else "", "js")


def decoded(text: str, found: list[tuple[int, int, str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The file with the character escapes of its literals resolved, and where each passage stands in it."""
    if "\\" not in text:
        return text, [(s, e) for s, e, *_ in found]
    out, spans, at, size = [], [], 0, 0
    for s, e, origin, inner in found:
        raw = text[s:e]
        if origin == "literal" and _CODED.search(raw):
            raw = raw[0] + inner + raw[-1]
        out += [text[at:s], raw]
        size += s - at + len(raw)
        spans.append((size - len(raw), size))
        at = e
    out.append(text[at:])
    return "".join(out), spans


def file_passages(text: str, found: list[tuple[int, int, str, str]], read: str, spans: list[tuple[int, int]], states: np.ndarray) -> Iterator[tuple[int, str, str, int]]:
    """(line, origin, language, characters) of each passage of prose among those of a file.

    `read` is the decoded file, in which the passages stand at `spans`, and `states` its segmentation.
    """
    breaks = None
    for (s, _, origin, inner), (a, b) in zip(found, spans, strict=True):
        # a phrase of three words has two gaps; scripts without gaps aren't ASCII
        if inner.isascii() and (len(inner) < 8 or len(inner.split(None, 2)) < 3):
            continue
        lang = judge(inner, read[a:b], states[a:b])
        if lang:
            if breaks is None:
                breaks = [m.start() for m in _NEWLINE.finditer(text)]
            yield bisect_left(breaks, s) + 1, origin, lang, len(inner)


def passages_of(files: list[tuple[str | None, str]]) -> Iterator[Iterator[tuple[int, str, str, int]]]:
    """The passages of prose of each (path, text)."""
    found = [sorted(passages(t, kind_of(p)), key=lambda x: x[0]) for p, t in files]
    read = [decoded(t, own) for (_, t), own in zip(files, found, strict=True)]
    states = segment([t for t, _ in read], [spans for _, spans in read])
    for (_, text), own, (r, spans), st in zip(files, found, read, states, strict=True):
        yield file_passages(text, own, r, spans, st)


def prose(df: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, line_no, origin, lang, chars): one row per passage; chars are those of its text."""
    kind = dict(df.dtypes)[key]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                paths, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                rows = []
                for i, own in enumerate(passages_of(list(zip(paths, texts, strict=True)))):
                    rows += [(i, *x) for x in own]
                if rows:
                    i, line, origin, lang, chars = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(i)), pa.array(line, pa.int64()), pa.array(origin), pa.array(lang), pa.array(chars, pa.int64())],
                        names=["k", "line_no", "origin", "lang", "chars"],
                    )

    return (
        df.where(F.length(F.col(f"`{text}`")) > 0)
        .select(F.col(f"`{key}`").alias("k"), F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(find, f"k {kind}, line_no bigint, origin string, lang string, chars bigint")
        .withColumnRenamed("k", key)
    )


def language_shares(found: DataFrame, key: str) -> DataFrame:
    """(key, lang, passages, chars, share): each language's part of a file's prose."""
    by = found.groupBy(key, "lang").agg(F.count("*").alias("passages"), F.sum("chars").alias("chars"))
    total = found.groupBy(key).agg(F.sum("chars").alias("total"))
    return by.join(total, key).select(key, "lang", "passages", "chars", (F.col("chars") / F.col("total")).alias("share"))
