"""Dense random-order indices within groups, without ever sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, ids: Sequence[str]):
    """A 63-bit pseudorandom sort key of the id columns; equal rows get equal keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]), 1)


def dense_index(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int = 42, bits: int = 10, name: str = "idx", order: Column | None = None) -> DataFrame:
    """Add ``name``: 0..n-1 within each group of ``keys``, in a seeded random order.

    A group is cut into 2**bits ranges of the hash of ``ids``; rows are numbered within a range and
    shifted by the sizes of the ranges before it, so a group that holds a third of all rows is still
    spread over 2**bits tasks. Null keys form a group of their own. Rows equal in all ``ids`` get
    distinct numbers in an arbitrary order. An empty table stays empty. ``order`` may give another order
    as a column of evenly spread hex digits, whose first three make the ranges.
    """
    b, h, off = "__bucket", "__hash", "__offset"
    keyed = df.withColumn(h, hash_order(seed, ids) if order is None else order)
    keyed = keyed.withColumn(b, F.shiftright(F.col(h), 63 - bits) if order is None else F.substring(h, 1, 3))
    renamed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    sizes = keyed.groupBy(*renamed, F.col(b).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[f"__k{i}" for i in range(len(keys))], "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(off))
    within = Window.partitionBy(*keys, b).orderBy(h, *ids)
    numbered = keyed.withColumn("__rank", F.row_number().over(within))
    on = F.col(b) == F.col("__b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = numbered.join(offsets, on, "left")
    return joined.withColumn(name, (F.col(off) + F.col("__rank") - 1).cast("bigint")).select(*df.columns, name)
