"""Samples that match target category proportions: systematic unequal-probability sampling with floors."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.paths import trim_ws
from framewright.operators.indexing import dense_index
from framewright.session import small_rows

MAX_TARGET_ROWS = 100_000
#: Inclusion probabilities are whole numbers of this part of one, so that running sums are exact at any length.
UNIT = 1 << 40


def category_key(c):
    """Names of categories are equal up to letter case and outer blanks."""
    return F.lower(trim_ws(c))


def category_report(df: DataFrame, targets: DataFrame, field: str) -> DataFrame:
    """One row per target: rows wanted, rows there, and whether the table has too few.

    All rows count in the total, those with a null category too. Over an empty table nothing is wanted.
    """
    counts = df.groupBy(category_key(F.col(field)).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    # a key that is no constant to the planner, which would plan a nested loop
    one = lambda c: F.pmod(F.xxhash64(c), F.lit(1))
    total = counts.groupBy(one("__c").alias("__one")).agg(F.sum("__n").alias("table_rows"))
    t = targets.select("plan_name", "category", category_key(F.col("category")).alias("category_key"), "target_share", F.col("min_rows").cast("bigint").alias("min_rows"), "sample_fraction")
    # `total` is one row, or none of an empty table
    j = t.withColumn("__one", one("plan_name")).join(F.broadcast(total), "__one", "left").withColumn("table_rows", F.coalesce("table_rows", F.lit(0))).join(counts, F.col("category_key") == F.col("__c"), "left")
    n = F.coalesce(F.col("__n"), F.lit(0)).cast("bigint")
    wanted = F.col("target_share") * F.col("sample_fraction") * F.col("table_rows")
    return j.select("plan_name", "category", "category_key", "target_share", "min_rows", "sample_fraction", F.col("table_rows").cast("bigint").alias("table_rows"), n.alias("category_rows"), wanted.alias("wanted"), (n < wanted).alias("too_few"))


def plan_rates(report: list, seed: int) -> list[tuple]:
    """Per plan, categories in sorted order with inclusion probability, prefix sum, random start and floor repair."""
    out = []
    for p, plan in enumerate(sorted({r.plan_name for r in report})):
        base = int(np.random.default_rng(seed * 7919 + p).random() * UNIT)
        for r in sorted((r for r in report if r.plan_name == plan), key=lambda r: r.category_key or ""):
            n = r.category_rows
            rate = round(min(1.0, r.wanted / n) * UNIT) if n else 0
            end = base + rate * n
            hit = end // UNIT - base // UNIT
            out.append((plan, r.category_key, rate, Decimal(base), max(0, min(r.min_rows, n) - hit), max(hit, min(r.min_rows, n))))
            base = end
    return out


def sample_to_targets(df: DataFrame, targets: DataFrame, field: str, id_col: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The sample (plan_name, category_key, id) and its report with the shares drawn.

    Within sorted categories rows have a random order; inclusion probabilities add up along it and a row
    is drawn where the running sum passes a whole number from one random start. As the probability is
    constant within a category, the sum at a row follows from its rank, which is counted per hash range.
    A category left under ``min(min_rows, its rows)`` gets the next rows not drawn. Rows of no target
    category are never drawn. ``targets`` must be a parameter table.
    """
    spark = df.sparkSession
    report = category_report(df, targets, field)
    rates = plan_rates(small_rows(report, MAX_TARGET_ROWS, "the table of category targets"), seed)
    r = spark.createDataFrame(rates, "plan_name string, category_key string, rate bigint, base decimal(34,0), repair bigint, drawn bigint")
    keyed = df.select(category_key(F.col(field)).alias("category_key"), F.col(id_col))
    wanted = keyed.join(F.broadcast(r.select("category_key").distinct()), "category_key")
    ranked = dense_index(wanted, ["category_key"], [id_col], seed)
    j = ranked.join(F.broadcast(r.filter("drawn > 0")), "category_key")
    at = lambda k: F.expr(f"(base + cast(rate AS decimal(13,0)) * cast({k} AS decimal(19,0))) div {UNIT}BD")
    hits_before = at("idx") - at("0")
    hit = at("idx + 1") > at("idx")
    repaired = (F.col("idx") - hits_before) < F.col("repair")
    sample = j.filter(hit | repaired).select("plan_name", "category_key", id_col, (~hit).alias("by_floor"))
    got = sample.groupBy(F.col("plan_name").alias("__gp"), F.col("category_key").alias("__gc")).agg(F.count(F.lit(1)).alias("__g"))
    full = report.join(got, (F.col("plan_name") == F.col("__gp")) & (F.col("category_key") == F.col("__gc")), "left")
    full = full.withColumn("drawn", F.coalesce(F.col("__g"), F.lit(0))).drop("__gp", "__gc", "__g")
    whole = F.sum("drawn").over(Window.partitionBy("plan_name"))
    full = full.withColumn("share_drawn", F.coalesce(F.try_divide(F.col("drawn"), whole), F.lit(0.0)))
    return sample, full.withColumn("missed", F.abs(F.col("drawn") - F.col("wanted")) >= 1.0)
