"""Exact-count samples, seeded shuffles and deterministic splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.rows import in_eval, sample_order
from framewright.operators.indexing import dense_index


def whole_table(some: str) -> Column:
    """The same value for every row, though no constant to the planner, which would plan joins on one as nested loops."""
    return F.pmod(F.xxhash64(some), F.lit(1))


def wanted_rows(total: Column, ratio: float) -> Column:
    """Rows of a stratum to draw: total x ratio rounded half to even, 1 at least, all at most."""
    return F.least(total, F.greatest(F.lit(1), F.bround(total * F.lit(float(ratio))).cast("bigint")))


def stratified_sample(df: DataFrame, strata: Sequence[str], ratio: float, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``wanted_rows`` rows of every stratum, the first in a seeded order; a null stratum is one of its own.

    One stratum may hold a third of all rows: ranks come from hash ranges, never from one window per stratum.
    """
    _check_ratio(ratio)
    if ratio == 1:
        return df
    sizes = df.groupBy(*[F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)]).agg(F.count(F.lit(1)).alias("__n"))
    on = F.lit(True)
    for i, s in enumerate(strata):
        on = on & F.col(s).eqNullSafe(F.col(f"__s{i}"))
    ranked = dense_index(df, strata, ids, name="__k", order=sample_order(seed, *[F.col(i) for i in ids]))
    return ranked.join(sizes, on).filter(F.col("__k") < wanted_rows(F.col("__n"), ratio)).select(*df.columns)


def global_sample(df: DataFrame, ratio: float, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``wanted_rows`` rows of the table; none of an empty one."""
    return stratified_sample(df.withColumn("__all", whole_table(ids[0])), ["__all"], ratio, ids, seed).drop("__all")


def sampling_stats(df: DataFrame, strata: Sequence[str], ratio: float) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*strata).agg(n.cast("bigint").alias("total"), wanted_rows(n, ratio).cast("bigint").alias("sampled"))


def shuffled(df: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in a seeded random order."""
    return df.orderBy(sample_order(seed, *[F.col(i) for i in ids]), *ids)


def placed(df: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``place``: 1..n in the order of ``shuffled``, without a sort of the whole table in one task."""
    order = sample_order(seed, *[F.col(i) for i in ids])
    ranked = dense_index(df.withColumn("__all", whole_table(ids[0])), ["__all"], ids, seed, name="place", order=order)
    return ranked.withColumn("place", F.col("place") + 1).drop("__all")


def head_split(df: DataFrame, fraction: float, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``split``: the first min(max(1, ceil(n x fraction)), n - 1) rows of a seeded order are eval. Fewer than two rows are an error."""
    ranked = dense_index(df.withColumn("__all", whole_table(ids[0])), ["__all"], ids, seed, name="__k", order=sample_order(seed, *[F.col(i) for i in ids]))
    n = df.groupBy(whole_table(ids[0]).alias("__all")).agg(F.count(F.lit(1)).alias("__n"))
    size = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(float(fraction))).cast("bigint"))
    checked = F.when(F.col("__n") < 2, F.raise_error(F.lit("a split needs two rows at least"))).otherwise(F.least(size, F.col("__n") - 1))
    # the right side is one row
    return ranked.join(F.broadcast(n), "__all").withColumn("split", F.when(F.col("__k") < checked, "eval").otherwise("train")).select(*df.columns, "split")


def hash_split(df: DataFrame, key: Column, fraction: float, seed: int = 42) -> DataFrame:
    """Add ``split`` by the key's hash bucket alone: no shuffle, and the same for batch and stream."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    return df.withColumn("split", F.when(in_eval(key, fraction, seed), "eval").otherwise("train"))


def _check_ratio(ratio: float) -> None:
    if not 0 < ratio <= 1:
        raise ValueError("ratio must lie in (0, 1]")
