"""Template residue, filler, error pages and script notices in place of content.

One character n-gram model per kind and one of natural prose are fitted from
short labelled texts. Along each line, the log-likelihood ratio of a kind to
prose is averaged over windows; characters inside windows above a threshold are
residue, and a line, or a paragraph of several lines, is a case of the kind whose
residue covers enough of it. Filler has three models: n-grams of the customary
texts, letters without any order, and a model that repeats what the line said
before. Before that, template fields, empty values, identifiers, numbers and inline
code become signs, so that what a template says counts and not its names. Lines of
code blocks and quotations are no content of the text's own.

Defined results
* Null and empty texts hold no case. CRLF is a line feed.
* A text may have several kinds, each once. Repeated rows give equal rows.
* Empty tables give none. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import residue_seeds, seeds

KINDS = ("placeholder", "filler", "error_page", "script_notice")
FILLER = 1
ORDERS = (1, 2, 3, 5)
WEIGHTS = (0.06, 0.14, 0.3, 0.5)
FLOOR = 2e-4
USUAL = -2.0  # log-likelihood of a character of prose that the seeds know
BACKGROUND = 2  # orders up to which prose is fitted from the texts of the kinds too, so that mere letters tell nothing (but for templates, whose signs do)
WINDOW, RATIO = 16, 0.8
LONG, LOW = 48, 0.3  # text without meaning gives little evidence a character, but all along
COVERAGE = 0.62
RECALLED = 8  # characters of the n-grams by which a line repeats itself
_BITS = (12, 16, 18, 19)  # of the tables by order
_PORTION = 200_000  # characters scored at once

# --- signs that stand for what varies
FIELD, EMPTY, NAME, INLINE = "", "", "", ""
_CODE = re.compile(r"`[^`\n]+`")
_FIELDS = re.compile(
    r"\$\{[^{}\n]*\}|#\{[^{}\n]*\}|\{\{[^{}\n]*\}\}|\[\[[^\[\]\n]+\]\]|<%=?[^%\n]*%>|%\([\w. -]+\)[sd]|%[A-Za-z][\w.-]*%|\$[A-Za-z][\w.]*\$"
    r"|\{%[^%\n]+%\}|<(?:your|my|the|insert|enter)[-_ ][\w. -]+>|<INSERT [^<>\n]+>|\[[A-Za-z]\w+(?:\.\w+)*\](?![(\[:])|(?<![\w/])\{[A-Za-z_][\w. -]*\}|@@[\w.]+@@|(?<!\w)__[A-Za-z][\w.]*__(?!\w)"
)
_EMPTIES = re.compile(r"\[object Object\]|\(none\)|(?<![\w'-])(?:undefined|null|NaN|None|nil|N/A)(?![\w'-])")
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_TOKEN = re.compile(r"[\w{}./-]*[\w{}]")


@lru_cache(100_000)
def _sign(t: str) -> str:
    if t.isalpha() and (t.islower() or t[1:].islower() or t.isupper()):
        return t
    if "/" in t or "_" in t or "{" in t or "}" in t:
        return NAME
    if any(c.isdigit() for c in t):
        return "0" if not any(c.isalpha() for c in t) or re.fullmatch("[0-9a-f]{6,}", t) else re.sub(r"\d+", "0", t)
    if any(a.islower() and b.isupper() for a, b in zip(t, t[1:], strict=False)) or re.fullmatch(r"[a-z]+(?:\.[a-z]+)+", t):
        return NAME
    return t


def normal(text: str) -> str:
    """The text with signs; lines stay lines."""
    if "`" in text:
        text = _CODE.sub(INLINE, text)
    if any(c in text for c in "{[<%@$") or "__" in text:
        text = _FIELDS.sub(FIELD * 2, text)
    text = _EMPTIES.sub(EMPTY, text)
    return _TOKEN.sub(lambda m: _sign(m.group()), _BLANKS.sub(" ", text))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray) -> dict[int, np.ndarray]:
    """By order, a hash of the characters that end at each place; line feeds stand before the first."""
    one = (np.concatenate([np.full(RECALLED, 10, np.uint64), codes]) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out, h = {1: one}, one
    for order in range(2, RECALLED + 1):
        h = np.concatenate([h[:1], (h[:-1] * np.uint64(0xFF51AFD7ED558CCD)) ^ one[1:]])
        out[order] = h
    return {o: x[RECALLED:] for o, x in out.items()}


def _slots(gram: np.ndarray, order: int) -> np.ndarray:
    bits = _BITS[ORDERS.index(order)]
    return (((gram ^ (gram >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - bits)).astype(np.int64)


def _lines(text: str) -> np.ndarray:
    """Codes of a seed's lines, each between two line feeds."""
    return _codes("\n\n" + "\n\n".join(normal(x) for x in text.split("\n") if x.strip()) + "\n")


def _fit(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: slots, and the chance of their character behind its context."""
    codes = _lines(text)
    grams = _grams(codes)
    out = []
    for order in ORDERS:
        whole, where, count = np.unique(grams[order], return_index=True, return_counts=True)
        if order == 1:
            chance = count / len(codes)
        else:
            before = np.concatenate([grams[order - 1][:1], grams[order - 1][:-1]])
            context, times = np.unique(before, return_counts=True)
            chance = count / times[np.searchsorted(context, before[where])]
        out.append((_slots(whole, order), chance))
    return out


def _texts() -> list[str]:
    own = {"filler": residue_seeds.PUBLIC_FILLER, "error_page": residue_seeds.PUBLIC_NOTICES, "script_notice": residue_seeds.PUBLIC_SCRIPTS}
    kinds = [getattr(residue_seeds, k.upper()) + own.get(k, "") for k in KINDS]
    return [*kinds, "\n".join([residue_seeds.TALK, *(getattr(seeds, k) for k in ("EN", "DE", "ES", "FR", "KO", "JA", "ZH"))])]


@cache
def models() -> list[np.ndarray]:
    """Per order, the weighted chances by slot: of the kinds and last of prose, side by side."""
    texts = _texts()
    fitted = [_fit(t) for t in texts]
    fitted[-1] = [_fit("\n".join(texts[1:]))[i] if o <= BACKGROUND else x for i, (o, x) in enumerate(zip(ORDERS, fitted[-1], strict=True))]
    out = []
    for o, (w, bits) in enumerate(zip(WEIGHTS, _BITS, strict=True)):
        table = np.zeros((1 << bits, 8), np.float32)
        for k, own in enumerate(fitted):
            slots, chance = own[o]
            np.maximum.at(table[:, k], slots, w * chance)
        out.append(table)
    return out


@cache
def _letters() -> np.ndarray:
    """log P(letter) where letters have no order."""
    code = _codes("".join(c for c in residue_seeds.PUBLIC_FILLER + seeds.EN if c.isascii()))
    count = np.bincount(code.astype(np.int64), minlength=128)[:128] + 20.0
    count[[i for i in range(128) if not chr(i).isalpha() and i != 32]] = 0.5
    return np.log(count / count.sum())


def ratios(codes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """log-likelihood ratio to prose at each character: of the kinds, of unordered letters, of repetition."""
    grams = _grams(codes)
    chance = np.full((len(codes), 8), FLOOR, np.float32)
    for order, table in zip(ORDERS, models(), strict=True):
        chance += table[_slots(grams[order], order)]
    logs = np.log(chance[:, : len(KINDS) + 1])
    prose = logs[:, -1]
    noise = np.where(codes < 128, _letters()[np.minimum(codes, 127).astype(np.int64)] - prose, np.float32(-1))
    # the line's own n-grams of RECALLED characters, each without itself, and counted as if it were rarer
    key = (line.astype(np.uint64) << np.uint64(40)) | (grams[RECALLED] >> np.uint64(24))
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]])))
    times = np.diff(np.append(start, len(key)))
    again = np.empty(len(key), np.float32)
    again[order] = np.repeat((times - 1) / (times + 3), times)
    said = np.log(np.maximum(again, 0.02)) - np.where(again > 0, np.maximum(prose, USUAL), 0)
    return np.vstack([(logs[:, :-1] - prose[:, None]).T, noise, said])


@cache
def _weights() -> np.ndarray:
    """Blanks and stops stand for nearly nothing."""
    w = np.array([1.0 if chr(i).isalnum() else 0.2 for i in range(0x10000)])
    w[[ord(c) for c in (FIELD, EMPTY, NAME, INLINE)]] = 4.0  # a word each
    return w


def covered(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per line: the weight of its characters, and of those in windows whose mean ratio is high, by kind."""
    codes = _codes("\n\n" + "\n\n".join([*forms, ""]))
    size = np.array([len(f.lower()) for f in forms])
    start = 2 + np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    own = np.repeat(np.arange(len(forms)), size)
    at = np.repeat(start, size) + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    line = np.full(len(codes), len(forms))
    line[at] = own
    r = ratios(codes, line)
    weight = _weights()[np.minimum(codes, 0xFFFF).astype(np.int64)][at]
    total = np.bincount(own, weights=weight, minlength=len(forms))
    hot = np.zeros((len(KINDS), len(codes)), bool)
    whole = np.zeros(len(codes) + 1)
    for k, ratio in enumerate(r):
        kind = k if k < len(KINDS) else FILLER
        np.cumsum(ratio, out=whole[1:])
        for w, high in ((WINDOW, RATIO), (LONG, LOW))[: 2 if kind == FILLER else 1]:
            if len(codes) >= w:
                found = ((whole[w:] - whole[:-w]) > high * w) & (line[: len(codes) - w + 1] == line[w - 1 :])
                inside = np.zeros(len(codes) + 1, np.int32)
                inside[: len(found)] += found
                inside[w : len(found) + w] -= found
                hot[kind] |= np.cumsum(inside[:-1]) > 0
        # a line shorter than a window is one itself, with no less evidence
        short = np.flatnonzero((size < WINDOW) & (whole[start + size] - whole[start] > RATIO * WINDOW))
        for i in short if k != len(KINDS) else ():  # letters without order need a whole window
            hot[kind, start[i] : start[i] + size[i]] = True
    got = np.stack([np.bincount(own, weights=h[at] * weight, minlength=len(forms)) for h in hot], axis=1)
    return total, got


_LEAD = re.compile(r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d{1,3}[.)]\s+)*")
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def own_lines(text: str) -> list[tuple[int, str]]:
    """(paragraph, normal form) of the lines that are the text's own content."""
    fenced = False
    out, paragraph = [], 0
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for line, form in zip(text.split("\n"), normal(text).split("\n"), strict=True):
        if _FENCE.match(line):
            fenced = not fenced
        elif not line.strip():
            paragraph += 1
        elif not fenced and not line.lstrip().startswith(">"):
            form = _LEAD.sub("", form).strip()
            if any(c.isalpha() or c in (FIELD, EMPTY) for c in form):
                out.append((paragraph, form))
    return out


def kinds_of(texts: list[str | None]) -> list[list[str]]:
    """The kinds of each text; texts are scored together, in bounded portions."""
    out: list[set] = [set() for _ in texts]
    lines: list[tuple[int, int, str]] = []

    def score() -> None:
        if not lines:
            return
        unit = np.cumsum([False, *(a[:2] != b[:2] for a, b in zip(lines, lines[1:], strict=False))])
        total, got = covered([f for _, _, f in lines])
        by_total = np.bincount(unit, weights=total)
        by_got = np.stack([np.bincount(unit, weights=g) for g in got.T], axis=1)
        first = np.concatenate(([0], np.flatnonzero(np.diff(unit)) + 1))
        for owner, t, g in ((np.arange(len(lines)), total, got), (first, by_total, by_got)):
            share = g / np.maximum(t, 1e-9)[:, None]
            best = share.argmax(1)
            for j in np.flatnonzero(share[np.arange(len(best)), best] >= COVERAGE):
                out[lines[owner[j]][0]].add(KINDS[best[j]])
        lines.clear()

    size = 0
    for i, t in enumerate(texts):
        for paragraph, form in own_lines(t) if t else ():
            lines.append((i, paragraph, form))
            size += len(form)
        if size > _PORTION:
            score()
            size = 0
    score()
    return [sorted(s) for s in out]


def kinds(text: str | None) -> list[str]:
    return kinds_of([text])[0]


def find_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind): each kind of residue that a text holds in place of content."""
    name = dict(df.dtypes)[key]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, found in enumerate(kinds_of(batch.column(1).to_pylist())):
                for k in found:
                    at.append(i)
                    out.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["k", "kind"])

    return (
        df.where(F.length(F.col(f"`{text}`")) > 0)
        .select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
        .mapInArrow(find, f"k {name}, kind string")
        .distinct()
        .withColumnRenamed("k", key)
    )


def without_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows that hold no residue (null keys stay)."""
    return df.join(find_residue(df, key, text).select(key).distinct(), key, "left_anti")
