"""Queries over rewards, advantages, metrics and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import resolve as V
from framewright.operators import rewards as W
from framewright.plans import dialect as D
from framewright.plans.registry import Registry
from framewright.session import table

R = Registry()
C = F.col

_SC = f"""(SELECT export_id, sft_mode, origin_id, acc, fmt, acc * 0.8::DOUBLE + fmt * 0.2::DOUBLE AS reward FROM (SELECT export_id, sft_mode, origin_id,
 CAST({D.choice_letter('output')} = {D.choice_letter('gold_answer')} AS DOUBLE) AS acc, CAST({D.format_ok('output')} AS DOUBLE) AS fmt FROM sft_export))"""


def _scored(spark, d):
    return W.score_rewards(table(spark, d, "sft_export").select("export_id", "sft_mode", "origin_id", "output", "gold_answer"), "output", "gold_answer")


@R.query("rewards", f"SELECT export_id, acc AS reward_accuracy, fmt AS reward_format, round(reward, 6) AS reward FROM {_SC}")
def rewards(spark, d):
    return _scored(spark, d).select("export_id", "reward_accuracy", "reward_format", F.round("reward", 6).alias("reward"))


@R.query("reward_summary", f"""SELECT round(avg(acc), 6) AS mean_reward_accuracy, round(avg(fmt), 6) AS mean_reward_format, round(avg(reward), 6) AS mean_reward,
 (SELECT round(avg(s), 6) FROM (SELECT stddev_samp(reward) AS s FROM {_SC} GROUP BY sft_mode, origin_id)) AS reward_std FROM {_SC}""")
def reward_summary(spark, d):
    out = W.reward_summary(_scored(spark, d), ["sft_mode", "origin_id"], ["reward_accuracy", "reward_format"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_LR = "CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END * 0.8::DOUBLE + CASE l_linestatus WHEN 'F' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"


def _rollouts(spark, d):
    r = F.when(C("l_returnflag") == "R", 1.0).when(C("l_returnflag") == "A", 0.5).otherwise(0.0) * 0.8 + F.when(C("l_linestatus") == "F", 0.2).otherwise(0.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("reward"))


@R.query("group_advantage", f"""SELECT l_orderkey, l_linenumber, round((r - avg(r) OVER w) / (stddev_samp(r) OVER w + 0.0001::DOUBLE), 6) + 0.0 AS advantage
 FROM (SELECT l_orderkey, l_linenumber, {_LR} AS r FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)""")
def group_advantage(spark, d):
    return W.group_advantage(_rollouts(spark, d), ["l_orderkey"]).select("l_orderkey", "l_linenumber", (F.round("advantage", 6) + 0.0).alias("advantage"))


@R.query("group_stats_to_members", f"SELECT l_orderkey, l_linenumber, round(avg(r) OVER w, 6) AS group_mean, round(stddev_samp(r) OVER w, 6) AS group_std FROM (SELECT l_orderkey, l_linenumber, {_LR} AS r FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)")
def group_stats_to_members(spark, d):
    return V.with_group_stats(_rollouts(spark, d), ["l_orderkey"], "reward").select("l_orderkey", "l_linenumber", F.round("group_mean", 6).alias("group_mean"), F.round("group_std", 6).alias("group_std"))


@R.query("weighted_reward_sum", "SELECT vec_id, round(e[1] * 0.5::DOUBLE + e[2] * 0.3::DOUBLE + e[3] * 0.2::DOUBLE, 6) AS reward FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def weighted_reward_sum(spark, d):
    from framewright.functions.arrays import weighted_sum

    e = F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 3)
    return table(spark, d, "embeddings").select("vec_id", F.round(weighted_sum(e, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))), 6).alias("reward"))


@R.query("step_metrics", "SELECT CAST(event_id // 1000 AS BIGINT) AS step, 'eval_' || event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def step_metrics(spark, d):
    df = table(spark, d, "events").withColumn("step", F.floor(C("event_id") / 1000).cast("bigint"))
    return W.step_metrics(df, "step", "event_type", "value", "eval_").withColumn("value", F.round("value", 6))


@R.query("metric_line", "SELECT user_id, 'step=' || CAST(count(*) AS VARCHAR) || ' | loss=' || printf('%.6f', round(avg(value), 4)) || ' | length=' || printf('%.2f', CAST(max(event_id) AS DOUBLE)) AS line FROM events GROUP BY user_id")
def metric_line(spark, d):
    df = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("loss"), F.max("event_id").cast("double").alias("length"))
    return df.select("user_id", W.metric_line(C("n"), [("loss", C("loss"), "%.6f"), ("length", C("length"), "%.2f"), ("kl", F.lit(None).cast("double"), "%.6f")]).alias("line"))


@R.query("low_rank_merge", """WITH b AS (SELECT vec_id AS i, unnest(range(4)) AS k, unnest(embedding[1:4]) AS bv FROM embeddings), a AS (SELECT vec_id AS k, unnest(range(64)) AS j, unnest(embedding) AS av FROM embeddings WHERE vec_id < 4)
 SELECT b.i, a.j, round(1.0::DOUBLE + sum(CAST(bv AS DOUBLE) * CAST(av AS DOUBLE)) * (32.0::DOUBLE / 4), 5) AS v FROM b JOIN a USING (k) GROUP BY ALL""")
def low_rank_merge(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v")).select(F.lit("w").alias("key"), C("vec_id").alias("i"), C("j").cast("bigint").alias("j"), C("v").cast("double").alias("v"))
    # one row of W and B for each vector of the table; A has as many rows as the rank
    b, a = e.filter("j < 4"), e.filter("i < 4")
    return W.low_rank_merge(e.withColumn("v", F.lit(1.0)), a, b, rank=4).select("i", "j", F.round("v", 5).alias("v"))
