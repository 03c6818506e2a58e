"""A mix of sources to target weights, in tokens, with a limit on repeats.

Sizes are counted in tokens of a public tokenizer. Weights come from tempering:
a source's weight is its own share of the tokens times (target / own share) to an
exponent, which runs from 0 (as found) to 1 (the targets); without targets it is
the own share to the exponent. The exponent is bisected to the greatest one that
keeps every source within its repeats at the size asked for, or to the entropy
asked for. Without a size, the mix is the largest that meets the targets.

Weights become token budgets. A source goes in whole as often as its budget
allows; of the next pass it gives a prefix of a pseudo-random permutation, cut
where the budget ends. The permutation is one of blocks: totals of hash blocks
are summed first, and rows are ordered within their block alone. So no source,
however large, has its rows sorted in one place.

Defined results
* Spellings of a source (case, blanks, `_` for `-`) are one source; null and
  unnamed sources aren't used. A named source without tokens gets nothing, and its
  share goes to the others in proportion.
* Null and empty texts have no tokens and aren't used. Rows without a key neither.
* A source's tokens miss its budget by less than its longest text.
* Every row is a text of its own, equal texts too. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codelode.session import cut

TOKENIZER = "byte_bpe_50k.tiktoken"
BLOCK_ROWS = 2000  # aimed at; what the one cut block of a source holds
_MANY = 1024  # blocks that are added up together
_TEXTS = 256


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[_ ]+", "-")


def count_tokens(df: DataFrame, key: str, source: str, text: str, path: str, pattern: str | None = None) -> DataFrame:
    """(k, source, tokens) of the rows with tokens."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    kind = dict(df.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(path, pattern)
        for batch in batches:
            texts, sizes = batch.column(2), []
            for at in range(0, len(texts), _TEXTS):
                sizes += [len(own.encode_ordinary(t)) for t in texts.slice(at, _TEXTS).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["k", "source", "tokens"])

    return (
        df.select(F.col(f"`{key}`").alias("k"), source_name(F.col(f"`{source}`")).alias("source"), F.col(f"`{text}`").alias("t"))
        .where(F.col("k").isNotNull() & F.col("source").isNotNull() & (F.length("t") > 0))
        .mapInArrow(count, f"k {kind}, source string, tokens bigint")
        .where(F.col("tokens") > 0)
    )


def tempered(sizes: dict[str, float], exponent: float, targets: dict[str, float] | None = None) -> dict[str, float]:
    total = sum(sizes.values())
    own = {s: n / total for s, n in sizes.items()}
    raw = {s: p**exponent if targets is None else p * (targets[s] / p) ** exponent if targets[s] > 0 else p * (exponent == 0) for s, p in own.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(good, steps: int = 60) -> float:
    """The greatest exponent in [0, 1] up to which `good` holds; 0 if it never does."""
    if good(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    return lo


def solve(
    sizes: dict[str, int],
    repeats: dict[str, float],
    targets: dict[str, float] | None = None,
    total: float | None = None,
    least_entropy: float | None = None,
) -> tuple[dict[str, float], float, float]:
    """(weights, total tokens, exponent) of the mix."""
    sizes = {s: n for s, n in sizes.items() if n > 0 and (targets is None or targets.get(s, 0) > 0) and repeats.get(s, 0) >= 1}
    if not sizes:
        return {}, 0.0, 0.0
    if targets is not None:
        whole = sum(targets[s] for s in sizes)
        targets = {s: targets[s] / whole for s in sizes}
    largest = lambda w: min(repeats[s] * sizes[s] / w[s] for s in sizes if w[s] > 0)
    exponent = 1.0
    if total is not None:
        total = min(total, sum(repeats[s] * n for s, n in sizes.items()))
        if targets is not None:
            exponent = _bisect(lambda a: largest(tempered(sizes, a, targets)) >= total * (1 - 1e-12))
        else:
            # the closer to 0, the more even, and the more often small sources repeat
            exponent = 1 - _bisect(lambda a: largest(tempered(sizes, 1 - a)) >= total * (1 - 1e-12))
    if least_entropy is not None and targets is None:
        exponent = min(exponent, _bisect(lambda a: entropy(tempered(sizes, a)) >= least_entropy))
    weights = tempered(sizes, exponent, targets)
    return weights, min(total, largest(weights)) if total is not None else largest(weights), exponent


def mix(counted: DataFrame, targets: DataFrame, total: float | None = None, of_corpus: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (k, source, tokens, uses, block, position), and per target its share asked for and reached.

    position is the text's place in its source's permutation, from 0: each pass goes
    through it in that order, and the last one ends where the budget does. With
    `of_corpus` the total is so many times the tokens of all named sources, and the
    exponent is bisected to what the repeats allow at that size.

    counted: (k, source, tokens); targets: (source, target_share, max_repeats), a table of a few named sources.
    """
    spark = counted.sparkSession
    wanted = {
        r["source"]: r
        for r in targets.where(F.col("source").isNotNull())
        .groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
        .collect()
    }
    counted = cut(counted.where(F.col("source").isin(list(wanted))))
    found = {r["source"]: r for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect()}
    if total is None and of_corpus:
        total = of_corpus * sum(r["tokens"] for r in found.values())
    weights, size, exponent = solve(
        {s: r["tokens"] for s, r in found.items()},
        {s: r["repeats"] or 0 for s, r in wanted.items()},
        {s: r["share"] or 0.0 for s, r in wanted.items()},
        total,
    )
    plan = []
    for s, w in weights.items():
        budget = min(size * w, found[s]["tokens"] * wanted[s]["repeats"])
        passes = int(budget // found[s]["tokens"] + 1e-9)
        rest = budget - passes * found[s]["tokens"]
        plan.append((s, passes, float(max(0.0, rest)), max(1, math.ceil(found[s]["rows"] / BLOCK_ROWS))))
    plans = F.broadcast(spark.createDataFrame(plan, "source string, passes int, rest double, blocks int"))  # a row per target
    place = F.xxhash64(F.lit(20), F.col("k"))
    rows = counted.join(plans, "source").withColumn("block", F.pmod(place, F.col("blocks")).cast("int")).withColumn("many", F.floor(F.col("block") / _MANY))
    # where each block starts, in tokens and rows: blocks are added up within groups of them, and the groups
    by_block = rows.groupBy("source", "many", "block").agg(F.sum("tokens").alias("size"), F.count("*").alias("n"))
    by_many = by_block.groupBy("source", "many").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups, blocks = Window.partitionBy("source").orderBy("many"), Window.partitionBy("source", "many").orderBy("block")
    by_many = by_many.select("source", "many", upto("size", groups).alias("size0"), upto("n", groups).alias("n0"))
    starts = by_block.withColumn("start", upto("size", blocks)).withColumn("first", upto("n", blocks)).join(by_many, ["source", "many"])
    starts = starts.select("source", "block", (F.col("start") + F.col("size0")).alias("start"), (F.col("first") + F.col("n0")).alias("first"))
    within = Window.partitionBy("source", "block").orderBy("place", "k")
    placed = (
        rows.withColumn("place", place)
        .withColumn("so_far", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("number", F.row_number().over(within) - 1)
        .join(starts, ["source", "block"])
    )
    # a text of the last pass counts if it ends within what the budget leaves
    extra = (F.col("start") + F.col("so_far") <= F.col("rest") + 1e-6).cast("int")
    mixed = placed.select(
        "k", "source", "tokens", (F.col("passes") + extra).alias("uses"), "block", (F.col("first") + F.col("number")).alias("position")
    ).where(F.col("uses") > 0)
    used = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.count("*").alias("docs_used"), F.max("uses").alias("most_uses")
    )
    everything = used.agg(F.sum("tokens_used").alias("all_tokens"))
    shares = (
        spark.createDataFrame(
            [(s, float(r["share"] or 0), int(r["repeats"] or 0), found[s]["tokens"] if s in found else 0) for s, r in wanted.items()],
            "source string, target_share double, max_repeats int, tokens_available long",
        )
        .join(used, "source", "left")
        .join(F.broadcast(everything), how="left")  # one row
        .select(
            "source", "target_share", "max_repeats", "tokens_available", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            F.coalesce(F.col("tokens_used") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.lit(exponent).alias("exponent"),
        )
    )
    return mixed, shares
