"""Queries on related rows, splits and overlaps between splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.llm import overlap, related
from framewright.llm.clips import clip_key_sql, real_id_sql
from framewright.plans.registry import Registry
from framewright.session import table

R = Registry()


def _groups(spark, d):
    return related.related_groups(table(spark, d, "grpo_rows").select("row_id", "video_id", "question_id", "dataset_name"))


# Clips that share a question are reached from one another step by step; each keeps the smallest.
GROUPS = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT row_id, video_id, {clip_key_sql('video_id')} AS clip, dataset_name || chr(31) || {real_id_sql('question_id')} AS ask FROM grpo_rows),
 hubs AS (SELECT ask, min(clip) AS hub FROM r WHERE clip IS NOT NULL AND ask IS NOT NULL GROUP BY ask),
 edge AS MATERIALIZED (SELECT DISTINCT hub AS a, clip AS b FROM r JOIN hubs USING (ask) WHERE clip <> hub),
 both_ways AS MATERIALIZED (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
 reach AS (SELECT DISTINCT a AS node, a AS root FROM both_ways UNION SELECT w.b, reach.root FROM reach JOIN both_ways w ON w.a = reach.node WHERE reach.root < w.b),
 roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
 placed AS (SELECT r.row_id, r.video_id, r.clip IS NOT NULL AS named, coalesce(r.clip, h.hub, chr(30) || r.ask) AS clip FROM r LEFT JOIN hubs h ON r.ask = h.ask WHERE r.clip IS NOT NULL OR r.ask IS NOT NULL),
 keyed AS (SELECT row_id, video_id, named, coalesce(root, clip) AS comp FROM placed LEFT JOIN roots ON placed.clip = roots.node),
 g AS (SELECT comp, CAST(count(*) AS BIGINT) AS group_rows, min(video_id) FILTER (named) AS group_key FROM keyed GROUP BY comp)"""


@R.query("p5_found", f"{GROUPS} SELECT row_id, group_key FROM keyed JOIN g USING (comp) WHERE group_rows >= 2")
def p5_found(spark, d):
    return _groups(spark, d).filter("group_rows >= 2").select("row_id", "group_key")


@R.query("p5_splits")
def p5_splits(spark, d):
    return related.assign_splits(spark, _groups(spark, d), "row_id")


_PART = "CAST(floor(count(*) * 0.1::DOUBLE + 0.5) AS BIGINT)"


@R.query("p5_split_totals", f"SELECT 'test' AS new_split, {_PART} AS n_rows FROM grpo_rows UNION ALL SELECT 'validation', {_PART} FROM grpo_rows UNION ALL SELECT 'train', CAST(count(*) AS BIGINT) - 2 * {_PART} FROM grpo_rows")
def p5_split_totals(spark, d):
    """Where single rows are at hand, every split has exactly its share."""
    return p5_splits(spark, d).groupBy("new_split").agg(F.count(F.lit(1)).alias("n_rows"))


@R.query("p5_split_report")
def p5_split_report(spark, d):
    s = p5_splits(spark, d)
    return s.groupBy("new_split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("comp").alias("n_groups"))


def _pairs(spark, d):
    return overlap.cross_split_pairs(table(spark, d, "grpo_rows").select("row_id", "video_id", "problem", "split_name"))


@R.query("p6_found")
def p6_found(spark, d):
    return _pairs(spark, d).select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


@R.query("p6_report")
def p6_report(spark, d):
    where = table(spark, d, "grpo_rows").select(F.col("row_id").alias("eval_id"), "split_name", "dataset_name")
    per_row = overlap.record_overlaps(_pairs(spark, d)).join(where, "eval_id")
    return per_row.groupBy("split_name", "dataset_name").agg(F.sum("partners").alias("n_pairs"), F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.round(F.min("overlap"), 6).alias("least_overlap"))
