"""Words as the text operators know them: runs of letters and digits, lower case."""

from __future__ import annotations

import re

import numpy as np
import regex
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}]+"


def words(text: Column) -> Column:
    """Array of words; of null text an empty one."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


_ASCII, _ANY = re.compile("[a-z0-9]+"), regex.compile(WORD)


def word_list(lowered: str) -> list[str]:
    """The words of a text in lower case."""
    return (_ASCII if lowered.isascii() else _ANY).findall(lowered)


class WordHashes:
    """64-bit hashes of words; what was met once is looked up, within a bound."""

    def __init__(self, bound: int = 200_000) -> None:
        self.known: dict[str, int] = {}
        self.bound = bound

    def __call__(self, ws: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        try:
            return np.array([known[w] for w in ws], dtype=np.uint64)
        except KeyError:
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.array([known[w] for w in ws], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps around)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
