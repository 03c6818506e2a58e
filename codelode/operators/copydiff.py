"""Differences between two copies of a table (column-by-bucket checksum matrix).

Both copies are reduced to their current rows as wide hashes only. The hashes
are added up per (key bucket, column), those of one copy with a minus sign, so
a cell that is not zero names a bucket and a column in which the copies differ.
Values are read and joined for such buckets alone, and compared in such columns
alone. Sums of 32-bit halves of two independent 64-bit hashes are kept per cell:
they cannot overflow below 2^31 rows a bucket (there are about ROWS_A_BUCKET), and equal sums of unequal
contents have a chance of about 2^-128.

Defined results
* A key that is null in every row cannot be matched and gives no row.
* Rows of a key that tie on the order column: the one with the larger row hash,
  in both copies alike, so exact duplicates change nothing.
* A null order value is earliest; null equals only null.
* Empty copies: every key of the other one is missing. Both empty: no rows.
* Columns outside `columns` are never read, whatever their names.
* A hot key is reduced map-side before the shuffle, so it costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import cut

ROWS_A_BUCKET = 8
BROADCAST_BUCKETS = 1 << 18  # so many unequal buckets (24 bytes each) are sent to every executor; more are joined by shuffle


def _cell_hash(seed: int, key: Column, value: Column) -> Column:
    # a hash skips nulls, so their presence is hashed beside the value
    return F.xxhash64(F.lit(seed), key, value.isNull(), value)


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(977), key), F.lit(n).cast("bigint"))


def _keyed(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    k = F.col(f"`{key}`")
    return df.where(k.isNotNull()).select(
        k.alias("k"), F.col(f"`{order}`").alias("o"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)]
    )


def _row_hash(n: int) -> Column:
    return F.xxhash64(*[x for i in range(n) for x in (F.col(f"v{i}").isNull(), F.col(f"v{i}"))])


def _current_hashes(rows: DataFrame, n: int) -> DataFrame:
    """One row a key: two 64-bit hashes of the key and of each value."""
    k = F.col("k")
    cells = [_cell_hash(s, k, k) for s in (3, 5)] + [
        _cell_hash(s + 2 * i, k, F.col(f"v{i}")) for i in range(n) for s in (1009, 50021)
    ]
    return (
        rows.select("k", F.struct("o", _row_hash(n).alias("r"), F.array(*cells).alias("h")).alias("s"))
        .groupBy("k")
        .agg(F.max("s").alias("s"))
        .select("k", "s.h")
    )


def buckets_for(rows: int) -> int:
    """A power of two with about ROWS_A_BUCKET rows each, at every size: a row that differs never drags many others along."""
    n = 256
    while n * ROWS_A_BUCKET < rows:
        n *= 2
    return n


def checksum_matrix(
    left: DataFrame, right: DataFrame, key: str, columns: list[str], order: str, buckets: int
) -> DataFrame:
    """(bucket, unequal): for each bucket that differs, a flag for the key and each column."""
    n = len(columns)
    signed = None
    for df, sign in ((left, 1), (right, -1)):
        part = _current_hashes(_keyed(df, key, columns, order), n).select(
            _bucket(F.col("k"), buckets).alias("bucket"), F.lit(sign).alias("g"), "h"
        )
        signed = part if signed is None else signed.unionByName(part)
    low, high = F.lit(0xFFFFFFFF).cast("long"), 32
    sums = []
    for j in range(2 * (n + 1)):
        h = F.col("h")[j]
        sums += [
            F.sum(F.col("g") * h.bitwiseAND(low)).alias(f"l{j}"),
            F.sum(F.col("g") * F.shiftrightunsigned(h, high)).alias(f"u{j}"),
        ]
    cells = signed.groupBy("bucket").agg(*sums)
    flags = [
        ~((F.col(f"l{2 * c}") == 0) & (F.col(f"u{2 * c}") == 0) & (F.col(f"l{2 * c + 1}") == 0) & (F.col(f"u{2 * c + 1}") == 0))
        for c in range(n + 1)
    ]
    return cells.select("bucket", F.array(*flags).alias("unequal")).where(F.exists("unequal", lambda x: x))


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    key: str,
    columns: list[str],
    order: str,
    left_name: str,
    right_name: str,
    buckets: int | None = None,
) -> DataFrame:
    """(key, field, status) for every key on one side only and every unequal value.

    status is `missing_in_<name>` with the key's name as field, or `differs`.
    """
    n = len(columns)
    buckets = buckets or buckets_for(max(left.count(), right.count()))
    unequal = cut(checksum_matrix(left, right, key, columns, order, buckets))  # read by both sides
    few = unequal.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    sides = []
    for df, side in ((left, "a"), (right, "b")):
        rows = _keyed(df, key, columns, order).withColumn("bucket", _bucket(F.col("k"), buckets))
        rows = rows.join(F.broadcast(unequal) if few else unequal, "bucket")
        found = rows.groupBy("k").agg(
            F.max(F.struct("o", _row_hash(n).alias("r"), *[f"v{i}" for i in range(n)])).alias(side),
            F.first("unequal").alias(f"u{side}"),
        )
        sides.append(found)
    both = sides[0].join(sides[1], "k", "full_outer")
    seen = F.coalesce("ua", "ub")
    fields = [
        F.when(
            F.col("a").isNotNull() & F.col("b").isNotNull() & seen[i + 1] & ~F.col(f"a.v{i}").eqNullSafe(F.col(f"b.v{i}")),
            F.struct(F.lit(c).alias("field"), F.lit("differs").alias("status")),
        )
        for i, c in enumerate(columns)
    ]
    lone = F.when(
        F.col("a").isNull() | F.col("b").isNull(),
        F.struct(
            F.lit(key).alias("field"),
            F.when(F.col("b").isNull(), F.lit(f"missing_in_{right_name}"))
            .otherwise(F.lit(f"missing_in_{left_name}"))
            .alias("status"),
        ),
    )
    return both.select("k", F.explode(F.array_compact(F.array(lone, *fields))).alias("x")).select(
        F.col("k").alias(key), F.col("x.field").alias("field"), F.col("x.status").alias("status")
    )


def diff_summary(found: DataFrame) -> DataFrame:
    """How many keys each kind of difference touches."""
    return found.groupBy("field", "status").agg(F.count("*").alias("n"))
