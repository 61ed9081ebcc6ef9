"""Queries over samples, shuffles and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import resolve as V
from framewright.operators import sampling as S
from framewright.plans.registry import Registry
from framewright.session import table

R = Registry()
C = F.col


def _rank(part: str, key: str, id_col: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({over}ORDER BY sha256('42::' || CAST({id_col} AS VARCHAR)), {id_col})"


def _n(part: str) -> str:
    return f"count(*) OVER (PARTITION BY {part})" if part else "count(*) OVER ()"


@R.query("stratified_sample", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, {_rank('lang', '', 'doc_id')} AS k, {_n('lang')} AS n FROM documents) WHERE k <= least(n, greatest(1, round_even(n * 0.3::DOUBLE, 0)))")
def stratified_sample(spark, d):
    return S.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], 0.3, ["doc_id"])


@R.query("stratified_sample_by_pair", f"SELECT row_id FROM (SELECT row_id, {_rank('dataset_name, split_name', '', 'row_id')} AS k, {_n('dataset_name, split_name')} AS n FROM grpo_rows) WHERE k <= least(n, greatest(1, round_even(n * 0.25::DOUBLE, 0)))")
def stratified_sample_by_pair(spark, d):
    return S.stratified_sample(table(spark, d, "grpo_rows").select("row_id", "dataset_name", "split_name"), ["dataset_name", "split_name"], 0.25, ["row_id"]).select("row_id")


@R.query("wide_sample_counts", "SELECT lang, CAST(least(count(*), greatest(1, round_even(count(*) * 0.3::DOUBLE, 0))) AS BIGINT) AS n FROM documents GROUP BY ALL")
def wide_sample_counts(spark, d):
    s = S.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], 0.3, ["doc_id"])
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@R.query("global_sample_size", "SELECT CAST(greatest(1, round_even(count(*) * 0.1::DOUBLE, 0)) AS BIGINT) AS n FROM grpo_rows")
def global_sample_size(spark, d):
    return S.global_sample(table(spark, d, "grpo_rows").select("row_id"), 0.1, ["row_id"]).agg(F.countDistinct("row_id").alias("n"))


@R.query("global_sample", f"SELECT row_id FROM (SELECT row_id, {_rank('', '', 'row_id')} AS k, {_n('')} AS n FROM grpo_rows) WHERE k <= least(n, greatest(1, round_even(n * 0.1::DOUBLE, 0)))")
def global_sample(spark, d):
    return S.global_sample(table(spark, d, "grpo_rows").select("row_id"), 0.1, ["row_id"])


@R.query("sample_shuffle", f"SELECT row_id, dataset_name, row_number() OVER (ORDER BY sha256('42::' || CAST(row_id AS VARCHAR)), row_id) AS place FROM (SELECT row_id, dataset_name, {_rank('dataset_name', '', 'row_id')} AS k, {_n('dataset_name')} AS n FROM grpo_rows) WHERE k <= least(n, greatest(1, round_even(n * 0.2::DOUBLE, 0)))")
def sample_shuffle(spark, d):
    return S.placed(S.stratified_sample(table(spark, d, "grpo_rows").select("row_id", "dataset_name"), ["dataset_name"], 0.2, ["row_id"]), ["row_id"])


@R.query("head_split_rows", f"SELECT o_orderkey, CASE WHEN {_rank('', '', 'o_orderkey')} <= least(greatest(1, ceil(count(*) OVER () * 0.05::DOUBLE)), count(*) OVER () - 1) THEN 'eval' ELSE 'train' END AS split FROM orders")
def head_split_rows(spark, d):
    return S.head_split(table(spark, d, "orders").select("o_orderkey"), 0.05, ["o_orderkey"])


@R.query("sampling_stats", "SELECT sft_mode, reasoning_depth, CAST(count(*) AS BIGINT) AS total, CAST(least(count(*), greatest(1, round_even(count(*) * 0.3::DOUBLE, 0))) AS BIGINT) AS sampled FROM sft_export GROUP BY ALL")
def sampling_stats(spark, d):
    return S.sampling_stats(table(spark, d, "sft_export"), ["sft_mode", "reasoning_depth"], 0.3)


@R.query("seeded_shuffle", f"SELECT s_suppkey, {_rank('', '', 's_suppkey')} AS place FROM supplier")
def seeded_shuffle(spark, d):
    return S.placed(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"])


@R.query("shuffle_eval_split", "SELECT CAST(least(greatest(1, ceil(count(*) * 0.05::DOUBLE)), count(*) - 1) AS BIGINT) AS n_eval, CAST(count(*) - least(greatest(1, ceil(count(*) * 0.05::DOUBLE)), count(*) - 1) AS BIGINT) AS n_train FROM orders")
def shuffle_eval_split(spark, d):
    s = S.head_split(table(spark, d, "orders").select("o_orderkey"), 0.05, ["o_orderkey"])
    return s.agg(F.count_if(C("split") == "eval").alias("n_eval"), F.count_if(C("split") == "train").alias("n_train"))


_HB = "CAST('0x' || substr(sha256('42::' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)"


@R.query("hash_split", f"SELECT o_orderkey, CASE WHEN {_HB} / 4294967295.0::DOUBLE < 0.05::DOUBLE THEN 'eval' ELSE 'train' END AS split FROM orders")
def hash_split(spark, d):
    return S.hash_split(table(spark, d, "orders").select("o_orderkey"), C("o_orderkey").cast("string"), 0.05)


@R.query("hash_split_stats", f"SELECT CASE WHEN {_HB} / 4294967295.0::DOUBLE < 0.05::DOUBLE THEN 'eval' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL")
def hash_split_stats(spark, d):
    return hash_split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@R.query("first_wins_dedup", "SELECT name, path FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY path) AS rn FROM media_catalogue WHERE name IS NOT NULL) WHERE rn = 1")
def first_wins_dedup(spark, d):
    return V.first_by(table(spark, d, "media_catalogue").filter("name IS NOT NULL").select("name", "path"), ["name"], ["path"])


@R.query("prefix_scan", "SELECT row_id, video_id FROM grpo_rows ORDER BY row_id LIMIT 50")
def prefix_scan(spark, d):
    return table(spark, d, "grpo_rows").select("row_id", "video_id").orderBy("row_id").limit(50)
