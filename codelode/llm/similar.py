"""Texts alike but for small edits: Order MinHash, banded alignment, exact count.

A text is a bag of words, the n-th copy of a word being another element than the
first; two texts are alike if sum(min counts) >= threshold * sum(max counts),
which is the Jaccard index of those elements. The elements sampled are
occurrence-labelled k-mers of `mer` words within a sentence. Since likeness is
counted by words wherever they stand, the default is one word; longer ones make
the candidates stricter about order and lose pairs that only the count calls
alike. Each of SKETCHES sketches samples the ELL elements of least hash and keeps
them in text order within their sentence; the sampled sentences are a set, so that
a sentence that was moved costs no agreement. Two texts agree in a sketch with a
chance of Jaccard^ELL times that of equal order: at the threshold one pair in
about 500 is not met, at 0.8 one in 16,000. ELL should grow with the logarithm of
the rows.

Texts of SHORT words and fewer have too few elements for that. They are found
exactly: alike texts share at least three of the elements of least hash that
remain when a text of n words leaves out all but the first n - ceil(threshold *
n) + 3, so equal triples of those meet.

A first pass over the texts gives class hashes and word profiles. Texts of equal
words are one class, and only one text of a class is sketched, so a group of
copies costs one row a sketch. A sketch that many different texts share is a skewed key of a plain
equi-join, which adaptive execution splits. Candidates whose word profiles (16
bytes) prove them unlike are dropped. The others are aligned in a band: its
matches are a lower bound of the shared words and mostly decide; where they don't,
words are counted exactly. So no pair that is returned is wrong.

Defined results
* Null and wordless texts are in no pair, null keys neither.
* Rows repeated under one key count once. Empty tables give no rows.
* Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.words import WordHashes, mix, word_list
from codelode.session import cut

THRESHOLD = 0.75
ELL = 6
SKETCHES = 32
MER = 1
SHORT = 16
_TRIPLE = 3
_BLOCK = 1000  # copies of a class that meet in one row group

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(2**64 - 1)
_WIDE = 1 << 21  # words times sketches of one text that are held at once

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
#: by width of the hash: multipliers, shift, and the longest text whose places fit into the low bits
_HASHING = {
    np.uint32: (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(15), 1 << 11),
    np.uint64: (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(32), 1 << 40),
}


def _labelled(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Element hashes: the n-th copy of a word in a text is another element than the first."""
    bits = np.uint64(max(1, int(doc[-1]).bit_length()))
    s = (doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(s, kind="stable")
    s = s[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    count = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    out = np.empty_like(h)
    out[order] = mix(h[order] + count.astype(np.uint64) * _GOLD)
    return out


def _mers(flat: np.ndarray, sentence: np.ndarray, doc: np.ndarray, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of `mer` words in a row of one sentence (a shorter sentence is one), with their sentences and texts."""
    g = flat.copy()
    last = np.ones(len(flat), bool)
    for j in range(1, mer):
        same = np.zeros(len(flat), bool)
        same[:-j] = sentence[j:] == sentence[:-j]
        g = mix(g * _GOLD + np.where(same, np.append(flat[j:], np.zeros(min(j, len(flat)), np.uint64))[: len(flat)], np.uint64(0)))
        last &= same
    first = np.concatenate(([True], sentence[1:] != sentence[:-1]))
    keep = last | first
    return g[keep], sentence[keep], doc[keep]


def sketches(texts: list[list[np.ndarray]], seeds: np.ndarray, ell: int, mer: int = 1) -> np.ndarray:
    """Order MinHashes (one row a text) of texts given as the word hashes of their sentences."""
    sizes = np.array([len(r) for t in texts for r in t])
    flat = np.concatenate([r for t in texts for r in t])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(len(texts)), [sum(map(len, t)) for t in texts])
    if mer > 1:
        flat, sentence, doc = _mers(flat, sentence, doc, mer)
    return _sketched(_labelled(flat, doc), sentence, np.bincount(doc, minlength=len(texts)), seeds, ell)


def _sketched(element: np.ndarray, sentence: np.ndarray, lengths: np.ndarray, seeds: np.ndarray, ell: int) -> np.ndarray:
    if len(seeds) > 1 and lengths.max() * len(seeds) > _WIDE:  # very long texts go through a few seeds at a time
        step = max(1, _WIDE // int(lengths.max()))
        if step < len(seeds):
            return np.concatenate([_sketched(element, sentence, lengths, seeds[i : i + step], ell) for i in range(0, len(seeds), step)], axis=1)
    start = np.concatenate(([0], np.cumsum(lengths)))
    out = np.empty((len(lengths), len(seeds)), np.uint64)
    by_length = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(by_length):
        # texts of like length, padded to the longest of them
        to = at + 1
        while to < len(by_length) and (to + 1 - at) * lengths[by_length[to]] * len(seeds) <= 1 << 18:
            to += 1
        part = by_length[at:to]
        width = int(lengths[part[-1]])
        kind = np.uint32 if width < _HASHING[np.uint32][3] else np.uint64
        times, again, shift, _ = _HASHING[kind]
        col = np.arange(width)
        inside = col[None, :] < lengths[part][:, None]
        where = np.where(inside, start[part][:, None] + col[None, :], 0)
        e = element[where]
        if kind is np.uint32:
            e = (e >> np.uint64(32)).astype(np.uint32)
        bits = kind(width.bit_length())
        low = (kind(1) << bits) - kind(1)
        x = (e[:, None, :] ^ (seeds >> np.uint64(64 - kind(0).nbytes * 8)).astype(kind)[None, :, None]) * times
        x ^= x >> shift
        x *= again
        # the place in the text goes into the low bits, so one partition finds hashes and places
        x &= ~low
        x |= col.astype(kind)
        x[np.broadcast_to(~inside[:, None, :], x.shape)] = np.iinfo(kind).max
        k = min(ell, width)
        pos = np.sort(np.partition(x, k - 1, axis=2)[:, :, :k] & low, axis=2).astype(np.int64)
        # words keep their order within a sentence, and what is sampled of one is mixed into one number of a sum
        total = np.broadcast_to(seeds, pos.shape[:2]).copy()
        run, last = np.zeros(pos.shape[:2], np.uint64), np.full(pos.shape[:2], -1)
        for j in range(k):
            real = pos[:, :, j] < width  # texts of fewer than ell words are padded
            flat = start[part][:, None] + np.where(real, pos[:, :, j], 0)
            sid = np.where(real, sentence[flat], -2)
            total += np.where(sid == last, np.uint64(0), mix(run))
            z = (np.where(sid == last, run, np.uint64(0)) ^ element[flat]) * _GOLD
            z ^= z >> np.uint64(29)
            run, last = np.where(real, z, np.uint64(0)), sid
        out[part] = mix(total + mix(run))
        at = to
    return out


def profiles(flat: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(words, lost, low, high) of n texts: words counted by 64 buckets of their hash, up to 3 each, in two bits."""
    c = np.bincount(doc * 64 + ((flat >> np.uint64(40)) & np.uint64(63)).astype(np.int64), minlength=n * 64).reshape(n, 64)
    kept = np.minimum(c, 3).astype(np.uint8)
    low, high = (np.packbits((kept >> b) & 1, axis=1, bitorder="little").view(np.int64)[:, 0] for b in (0, 1))
    words = c.sum(1)
    return words, words - kept.sum(1), low, high


def _may_be_alike(threshold: float) -> F.Column:
    """False only if the profiles prove that two texts share too few words."""
    twos = F.bit_count(F.col("ha").bitwiseAND(F.col("hb")))
    # min of two-bit counts, summed over the buckets: both have the high bit: 2, and 1 more
    # if both low bits are set; else the smaller low part, where a high bit stands for enough
    both = F.col("ha").bitwiseAND(F.col("hb"))
    only_a = F.col("ha").bitwiseAND(F.bitwise_not("hb"))
    only_b = F.col("hb").bitwiseAND(F.bitwise_not("ha"))
    none = F.bitwise_not(F.col("ha").bitwiseOR(F.col("hb")))
    low = F.col("la").bitwiseAND(F.col("lb"))
    most = (
        2 * twos
        + F.bit_count(both.bitwiseAND(low))
        + F.bit_count(only_a.bitwiseAND(F.col("lb")))
        + F.bit_count(only_b.bitwiseAND(F.col("la")))
        + F.bit_count(none.bitwiseAND(low))
        + F.least("xa", "xb")
    )
    return most >= threshold * (F.col("na") + F.col("nb") - most)


def triples(h: np.ndarray, threshold: float) -> list[int]:
    """What short texts are found by: triples among the elements of least hash that alike texts must share three of."""
    n = len(h)
    element = np.sort(_labelled(h, np.zeros(n, np.int64))).tolist()
    least = element[: n - math.ceil(threshold * n - 1e-9) + _TRIPLE]
    return [hash(t) for t in combinations(least, _TRIPLE)]


def aligned(a: list[str], b: list[str], band: int) -> int:
    """Words matched by the best alignment that strays at most `band` words from the diagonal.

    Bit-parallel: one big integer holds a row of the table, and matches outside
    the band are masked out.
    """
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v, window = full, (1 << (2 * band + 1)) - 1
    for i, w in enumerate(a):
        m = where.get(w, 0)
        if not m:
            continue
        m &= (window << (i - band)) if i >= band else (window >> (band - i))
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def alike(a: list[str], b: list[str], threshold: float) -> bool:
    total = len(a) + len(b)
    if not a or not b or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    need = lambda shared: shared >= threshold * (total - shared)
    known = set(a)
    if not need(sum(w in known for w in b)):  # no less than what they share
        return False
    if need(aligned(a, b, max(8, int(len(b) * (1 - threshold))))):
        return True
    return need((Counter(a) & Counter(b)).total())


def _sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any."""
    found = (word_list(s) for s in _SENTENCE.split(text.lower()))
    return [ws for ws in found if ws]


def _read(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return rows.where(F.col("k").isNotNull() & F.col("t").isNotNull())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of the texts that have words; and of all their words the hash, the sentence and the text."""
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            texts = [_sentences(t) for t in part.column(1).to_pylist()]
            good = [i for i, t in enumerate(texts) if t]
            if good:
                sizes = np.array([len(s) for i in good for s in texts[i]])
                flat = hashes(list(chain.from_iterable(s for i in good for s in texts[i])))
                doc = np.repeat(np.repeat(np.arange(len(good)), [len(texts[i]) for i in good]), sizes)
                yield part.column(0).take(pa.array(good)), flat, np.repeat(np.arange(len(sizes)), sizes), doc


def fingerprints(rows: DataFrame) -> DataFrame:
    """(k, c1, c2, n, x, l, h): class hashes and word profile of each text (k, t) with words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, flat, _, doc in _hashed(batches):
            words, *others = profiles(flat, doc, len(keys))
            first = np.concatenate(([0], np.cumsum(words)[:-1]))
            sums = [np.add.reduceat(mix(flat ^ x), first).view(np.int64) for x in (np.uint64(1), _GOLD)]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in (*sums, words, *others))], names=["k", "c1", "c2", "n", "x", "l", "h"])

    return rows.mapInArrow(find, f"k {rows.dtypes[0][1]}, c1 bigint, c2 bigint, n bigint, x bigint, l bigint, h bigint")


def sketch_rows(rows: DataFrame, threshold: float, ell: int, n: int, mer: int) -> DataFrame:
    """(k, sketch): the sketches of each text (k, t), or the triples of a short one."""
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD)
    overlap = int(SHORT / threshold)  # a short text may be alike one of so many words

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, flat, sentence, doc in _hashed(batches):
            words = np.bincount(doc, minlength=len(keys))
            first = np.concatenate(([0], np.cumsum(words)[:-1]))
            at, found = [], []
            long = np.flatnonzero(words > SHORT)
            if len(long):
                own = np.isin(doc, long)
                g, sid, d = flat[own], sentence[own], doc[own]
                if mer > 1:
                    g, sid, d = _mers(g, sid, d, mer)
                d = np.searchsorted(long, d)
                found.append(_sketched(_labelled(g, d), sid, np.bincount(d, minlength=len(long)), seeds, ell).view(np.int64).ravel())
                at.append(np.repeat(long, n))
            for i in np.flatnonzero((words <= overlap) & (words >= _TRIPLE)):
                found.append(np.array(triples(flat[first[i] : first[i] + words[i]], threshold), np.int64))
                at.append(np.full(len(found[-1]), i))
            if found:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(found))], names=["k", "sketch"])

    return rows.mapInArrow(find, f"k {rows.dtypes[0][1]}, sketch bigint")


def alike_classes(
    df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, ell: int = ELL, n: int = SKETCHES, mer: int = MER
) -> tuple[DataFrame, DataFrame]:
    """Members (k, rep): each text's key and the least key of its words' class; links (a, b), a < b: alike classes."""
    kind = dict(df.dtypes)[key]
    rows = _read(df, key, text)
    known = cut(fingerprints(rows))
    reps = known.groupBy("c1", "c2").agg(F.min("k").alias("rep"))
    members = known.select("k", "c1", "c2").join(reps, ["c1", "c2"]).select("k", "rep").distinct()
    # one exchange of the texts serves the sketches and both sides of the verification
    texts = rows.join(reps.select(F.col("rep").alias("k")), "k", "left_semi")
    met = sketch_rows(texts, threshold, ell, n, mer)
    one, two = met.withColumnRenamed("k", "a"), met.withColumnRenamed("k", "b")
    pairs = one.join(two, "sketch").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    for side in "ab":
        pairs = pairs.join(known.select(*[F.col(c).alias(side if c == "k" else c + side) for c in ("k", "n", "x", "l", "h")]), side)
    pairs = pairs.where(_may_be_alike(threshold)).select("a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, list[str]] = {}  # a text meets several others

        def of(t: str) -> list[str]:
            if t not in lists:
                if len(lists) > 2000:
                    lists.clear()
                lists[t] = word_list(t.lower())
            return lists[t]

        for batch in batches:
            good = [alike(of(x), of(y), threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    ta, tb = texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), texts.select(F.col("k").alias("b"), F.col("t").alias("tb"))
    links = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(verify, f"a {kind}, b {kind}").distinct()
    return members, links


def alike_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(a, b), a < b: every alike pair of rows, copies included."""
    members, links = alike_classes(df, key, text, threshold, **how)
    # most classes have one member, and their links are pairs as they stand
    members = cut(members)
    sizes = members.groupBy("rep").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    several = members.join(sizes, "rep")
    left = several.select(F.col("k").alias("x"), F.col("rep").alias("a"))
    right = several.select(F.col("k").alias("y"), F.col("rep").alias("b"))
    across = (
        links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    )
    # a large class meets itself in blocks, each pair of blocks a key of its own
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    own = several.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(7), "k"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = own.select("rep", F.col("k").alias("x"), F.col("own").alias("i"), other.alias("j"))
    cols = own.select("rep", F.col("k").alias("y"), F.col("own").alias("j"), other.alias("i"))
    within = rows.join(cols, ["rep", "i", "j"]).where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def alike_members(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(k, class_id, links): one row a text, with its class and the class's number of alike classes."""
    members, links = alike_classes(df, key, text, threshold, **how)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep"))
    degree = ends.groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(degree, "rep", "left").select(
        F.col("k").alias(key), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
