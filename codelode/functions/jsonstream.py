"""A strict, non-recursive JSON reader that emits path-value-ordinal triples.

The text is read once, token by token; nothing is built but the triples, so
depth is bounded by the text and not by a call stack. A path is a tuple of
member names, in which `[]` stands for any array position; the ordinals are
those positions, from the outermost array inwards.
"""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(
    r"""[ \t\n\r]*(?:(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")"""
    r"""|(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<w>true|false|null)|(?P<p>[][{}:,]))"""
)
_WORDS = {"true": ("boolean", True), "false": ("boolean", False), "null": ("null", None)}

#: kinds of a triple's value
SCALARS = ("string", "number", "boolean", "null")


class NotJson(ValueError):
    pass


class Integer(str):
    """An integer of more digits than the interpreter converts, kept as its digits; it is a number all the same."""


def _number(text: str):
    """Equal JSON numbers give equal values: 1, 1.0 and 1e0 are one number."""
    if not any(c in text for c in ".eE"):
        return int(text) if len(text) < 4000 else Integer(text)
    x = float(text)
    return int(x) if x.is_integer() and abs(x) < 2**53 else x


def triples(text: str):
    """Yield (path, ordinals, kind, value) of every scalar and every container's start.

    Containers have the kinds `object` and `array` and the value None, and come
    before what they hold. Of members named alike in one object, all come out,
    in order. NotJson is raised at the first thing that is no JSON.
    """
    if text.startswith("﻿"):
        text = text[1:]
    at, size = 0, len(text)
    path: list[str] = []
    ordinals: list[int] = []
    stack: list[str] = []  # "{" or "["
    want = "value"  # value, first (value or ]), key, firstkey (key or }), colon, next (comma or end)
    match = _TOKEN.match
    while True:
        m = match(text, at)
        if not m:
            if text[at:].strip(" \t\n\r"):
                raise NotJson(f"at {at}")
            if stack or want != "next":
                raise NotJson("cut off")
            return
        at = m.end()
        group, token = m.lastgroup, m.group(m.lastgroup)
        if not stack and want == "next":
            raise NotJson("more than one value")
        if group == "p":
            if token in "{[":
                if want not in ("value", "first"):
                    raise NotJson(token)
                yield tuple(path), tuple(ordinals), "object" if token == "{" else "array", None
                stack.append(token)
                if token == "[":
                    path.append("[]")
                    ordinals.append(0)
                    want = "first"
                else:
                    want = "firstkey"
                continue
            if token in "}]":
                if not stack or (token == "}") != (stack[-1] == "{") or want not in ("next", "first" if token == "]" else "firstkey"):
                    raise NotJson(token)
                stack.pop()
                if token == "]":
                    path.pop()
                    ordinals.pop()
            elif token == ",":
                if want != "next":
                    raise NotJson(token)
                if stack[-1] == "[":
                    ordinals[-1] += 1
                    want = "value"
                else:
                    want = "key"
                continue
            else:
                if want != "colon":
                    raise NotJson(token)
                want = "value"
                continue
        elif group == "s" and want in ("key", "firstkey"):
            path.append(_text(token))
            want = "colon"
            continue
        else:
            if want not in ("value", "first"):
                raise NotJson(token)
            if group == "s":
                kind, value = "string", _text(token)
            elif group == "n":
                kind, value = "number", _number(token)
            else:
                kind, value = _WORDS[token]
            yield tuple(path), tuple(ordinals), kind, value
        # a value has ended
        if stack and stack[-1] == "{":
            path.pop()
        want = "next"
        if at >= size and not stack:
            return


def _text(token: str) -> str:
    if "\\" not in token:
        return token[1:-1]
    s = json.loads(token)
    # half of a surrogate pair can't be stored as UTF-8
    return s if s.isprintable() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
