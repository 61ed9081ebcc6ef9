"""Rewards, group-relative advantages, step metrics and low-rank merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import text as T

Reward = Callable[[Column, Column], Column]
# Default weights and the term that keeps the divisor from zero.
WEIGHTS = {"accuracy": 0.8, "format": 0.2}
EPSILON = 1e-4

REWARDS: dict[str, Reward] = {
    "accuracy": lambda completion, solution: (T.choice_letter(completion) == T.choice_letter(solution)).cast("double"),
    "format": lambda completion, solution: T.format_ok(completion).cast("double"),
}


def register_reward(name: str, reward: Reward) -> None:
    """Add a reward; a Pandas UDF works as well as a built-in expression."""
    if name in REWARDS:
        raise ValueError(f"reward {name} exists")
    REWARDS[name] = reward


def resolve_weights(names: Sequence[str], listed: Sequence[float] | None = None, named: dict[str, float] | None = None) -> dict[str, float]:
    """Defaults, overridden by a list in the order of names, overridden by name."""
    if listed is not None and len(listed) != len(names):
        raise ValueError("as many weights as rewards are needed")
    out = {n: WEIGHTS.get(n, 1.0) for n in names}
    out.update(zip(names, listed or [], strict=False))
    unknown = set(named or {}) - set(names)
    if unknown:
        raise ValueError(f"weights of unknown rewards: {sorted(unknown)}")
    return out | (named or {})


def score_rewards(df: DataFrame, completion: str, solution: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``reward_<name>`` columns and their weighted sum ``reward``."""
    weights = weights or WEIGHTS
    parts = {n: REWARDS[n](F.col(completion), F.col(solution)) for n in weights}
    scored = df.select("*", *[p.alias(f"reward_{n}") for n, p in parts.items()])
    total = sum((F.col(f"reward_{n}") * F.lit(float(w)) for n, w in weights.items()), F.lit(0.0))
    return scored.withColumn("reward", total)


def group_advantage(df: DataFrame, group: Sequence[str], reward: str = "reward") -> DataFrame:
    """Add ``advantage`` = (reward - group mean) / (sample deviation + EPSILON); NULL in a group of one."""
    w = Window.partitionBy(*group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + F.lit(EPSILON)))


def reward_summary(df: DataFrame, group: Sequence[str], rewards: Sequence[str]) -> DataFrame:
    """One row: mean of each reward, of the total, and of the groups' deviations."""
    # sums per group first, then one row: no group and no row is read twice, and nothing is joined
    n = F.col("__n")
    sums = [F.sum(F.col(r).cast("double")).alias(f"__s{i}") for i, r in enumerate([*rewards, "reward"])]
    met = [F.count(F.col(r)).alias(f"__c{i}") for i, r in enumerate([*rewards, "reward"])]
    per = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("reward").alias("__sd"), *sums, *met)
    names = [*[f"mean_{r}" for r in rewards], "mean_reward"]
    means = [F.try_divide(F.sum(f"__s{i}"), F.sum(f"__c{i}")).alias(name) for i, name in enumerate(names)]
    return per.agg(*means, F.avg("__sd").alias("reward_std"), F.sum(n).alias("__rows")).filter(F.col("__rows") > 0).drop("__rows")


def step_metrics(df: DataFrame, step: str, metric: str, value: str, prefix: str = "") -> DataFrame:
    return df.groupBy(F.col(step), F.concat(F.lit(prefix), F.col(metric)).alias("metric")).agg(F.avg(value).alias("value"))


def metric_line(step: Column, metrics: list[tuple[str, Column, str]]) -> Column:
    """``step=n | name=value`` parts in a fixed order and precision; NULL metrics are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{n}="), F.format_string(f, v))) for n, v, f in metrics]
    return F.concat_ws(" | ", F.concat(F.lit("step="), step.cast("string")), *parts)


def low_rank_merge(w: DataFrame, a: DataFrame, b: DataFrame, rank: int, alpha: float = 32.0) -> DataFrame:
    """(key, i, j, v) of W + (B A) alpha / rank. Keys without a pair keep W. All tables are (key, i, j, v)."""
    prod = b.select("key", "i", F.col("j").alias("k"), F.col("v").alias("bv")).join(a.select("key", F.col("i").alias("k"), "j", F.col("v").alias("av")), ["key", "k"])
    delta = prod.groupBy("key", "i", "j").agg((F.sum(F.col("bv") * F.col("av")) * F.lit(alpha / rank)).alias("d"))
    return w.join(delta, ["key", "i", "j"], "left").select("key", "i", "j", (F.col("v") + F.coalesce("d", F.lit(0.0))).alias("v"))
