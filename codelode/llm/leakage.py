"""Evaluation texts inside a corpus: size-partitioned MinHash containment search.

Items are partitioned by size: those of `window` words or more are sought by
windows of that many words, each shorter size by windows of its own. The MinHash
of a window is the least hash among its shingles, so equal windows have equal
minima and no shared window can be missed; neighbouring windows mostly share
theirs, so an item and a document are each known by a fraction of their windows.
Documents are read once, their windows filtered by the items' minima, and what is
left is verified by comparing whole windows word by word.

The filter is a Bloom filter of the items' minima, one for all sizes. Its bits are
set and merged on the executors, and its size is fixed (BITS, 16 MB), whatever the
number of items; more items only let more windows through to the exact join.

Defined results
* Null, empty and wordless texts hold nothing and are held by nothing.
* Words are compared by their lower case; what stands between them is ignored.
* Repeated ids count once. Empty tables give no rows.
* Only the two named columns of either table are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.words import WordHashes, mix, words

WINDOW = 12
SHINGLE = 5
BITS = 27  # the filter has 2 to this many
_BATCH = 200_000  # words handled at once


def window_minima(hashes: np.ndarray, window: int, shingle: int = SHINGLE) -> np.ndarray:
    """MinHash of the shingles of each window of a run of word hashes."""
    k = min(shingle, window)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(s)]
    s = mix(s)
    out = s[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(out, s[j : j + n], out=out)
    return out


def _places(minima: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each minimum of a size."""
    h = mix(minima + np.uint64(size) * np.uint64(0xC2B2AE3D27D4EB4F))
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def _known(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1


def _windows(batches: Iterator[pa.RecordBatch], sizes: list[int], own_size: bool, wanted) -> Iterator[pa.RecordBatch]:
    """(id, size, minimum, text) of windows, each once a text; of items only those of their own partition's size."""
    hashes = WordHashes()
    bits = None if wanted is None else wanted.value
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        offsets = np.asarray(lists.offsets)
        flat = lists.values
        i = 0
        while i < len(ids):
            j = i + 1
            while j < len(ids) and offsets[j + 1] - offsets[i] <= _BATCH:
                j += 1
            ws = flat.slice(offsets[i], offsets[j] - offsets[i]).to_pylist()
            h = hashes(ws)
            edge = offsets[i : j + 1] - offsets[i]
            doc = np.repeat(np.arange(j - i), np.diff(edge))
            rows = ([], [], [], [])
            for size in sizes:
                m = window_minima(h, size)
                if not len(m):
                    continue
                good = doc[: len(m)] == doc[size - 1 : size - 1 + len(m)]  # no window spans two texts
                if own_size:
                    length = np.diff(edge)[doc[: len(m)]]
                    good &= (length == size) if size < WINDOW else (length >= size)
                if bits is not None:
                    one, two = _places(m, size, len(bits).bit_length() + 5)  # a power of two of 64-bit words
                    good &= _known(bits, one)
                    good[good] = _known(bits, two[good])
                seen = set()  # a window that a text repeats counts once
                for p in np.flatnonzero(good):
                    row = (i + int(doc[p]), size, int(m[p].view(np.int64)), " ".join(ws[p : p + size]))
                    if row not in seen:
                        seen.add(row)
                        for column, x in zip(rows, row, strict=True):
                            column.append(x)
            if rows[0]:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string())],
                    names=["id", "size", "minimum", "window"],
                )
            i = j


def _run(df: DataFrame, key: str, text: str, sizes: list[int], own_size: bool, wanted=None) -> DataFrame:
    kind = dict(df.dtypes)[key]
    return (
        df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{key}`").isNotNull())
        .select(F.col(f"`{key}`").alias("id"), words(F.col(f"`{text}`")).alias("words"))
        .mapInArrow(
            lambda batches: _windows(batches, sizes, own_size, wanted), f"id {kind}, size int, minimum bigint, window string"
        )
    )


def _filter(item_windows: DataFrame, size_bits: int) -> np.ndarray:
    """The Bloom filter of the minima, as 64-bit words; only words with bits come to the driver, at most 2^size_bits / 64."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, m = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for s in np.unique(size):
                at = np.concatenate(_places(m[size == s], int(s), size_bits))
                word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bit"])

    words = item_windows.select("size", "minimum").mapInArrow(places, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(1 << (size_bits - 6), np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def find_leaks(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, window: int = WINDOW, bits: int = BITS
) -> DataFrame:
    """(doc_key, item_key, windows): items of which a document holds `window` words in a row, or all of a shorter one."""
    spark = docs.sparkSession
    item_windows = _run(items, item_key, item_text, list(range(1, window + 1)), True).distinct()
    sizes = sorted(r["size"] for r in item_windows.select("size").distinct().collect())  # at most `window` of them
    wanted = spark.sparkContext.broadcast(_filter(item_windows, bits))
    doc_windows = _run(docs, doc_key, doc_text, sizes, False, wanted)
    return (
        doc_windows.withColumnRenamed("id", "doc")
        .join(item_windows.withColumnRenamed("id", "item"), ["size", "minimum", "window"])
        .groupBy("doc", "item")
        .agg(F.count_distinct("window").alias("windows"))
        .select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "windows")
    )
