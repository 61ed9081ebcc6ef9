"""Queries over weight keys, nested metadata, joined paths and split maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import paths as P
from framewright.functions import rows as W
from framewright.operators import resolve as V
from framewright.plans.registry import Registry
from framewright.session import table
from framewright.sources import jsonl

R = Registry()
C = F.col

# Key shapes of adapter and quantised weights, one for each remainder of the part number.
_SHAPES = [
    "base_model.model.model.language_model.layers.{}.lora_A.weight",
    "base_model.model.model.visual.blocks.{}.attn.weight",
    "base_model.model.model.visual.merger.{}.lora_B.weight",
    "model.visual.merger.{}.lora_A.weight.SCB",
    "wrapped.model.layers.{}.weight_format",
    "visual.merger.mlp.{}.SCB.scale",
]
_KEYS = "SELECT p_partkey, CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{a}' || p_partkey || '{b}'" for i, (a, b) in enumerate(s.split("{}") for s in _SHAPES)) + " END AS key FROM part"


def _keys(spark, d):
    key = F.lit(None).cast("string")
    for i, (a, b) in enumerate(s.split("{}") for s in _SHAPES):
        key = F.when(C("p_partkey") % 6 == i, F.concat(F.lit(a), C("p_partkey").cast("string"), F.lit(b))).otherwise(key)
    return table(spark, d, "part").select("p_partkey", key.alias("key"))


@R.query("adapter_keys", f"""SELECT p_partkey, CASE WHEN contains(k, '.visual.merger.') THEN replace(replace(k, 'lora_A.weight', 'lora_A.default.weight'), 'lora_B.weight', 'lora_B.default.weight') ELSE k END AS key
 FROM (SELECT p_partkey, replace(replace(replace(key, '.model.model.language_model.layers.', '.model.model.layers.'), '.model.model.visual.blocks.', '.model.visual.blocks.'), '.model.model.visual.merger.', '.model.visual.merger.') AS k FROM ({_KEYS}))""")
def adapter_keys(spark, d):
    return _keys(spark, d).select("p_partkey", W.adapter_key(C("key")).alias("key"))


@R.query("loader_keys", f"SELECT p_partkey, CASE WHEN starts_with(key, 'wrapped.') THEN substr(key, 9) WHEN starts_with(key, 'base_model.') THEN substr(key, 12) ELSE key END AS key FROM ({_KEYS}) WHERE NOT (key LIKE '%.SCB' OR key LIKE '%.weight!_format' ESCAPE '!' OR contains(key, '.SCB.'))")
def loader_keys(spark, d):
    return _keys(spark, d).filter(~W.is_quantiser_key(C("key"))).select("p_partkey", W.strip_wrapper(C("key"), "wrapped.").alias("key"))


@R.query("weight_shards", f"SELECT CAST(p_partkey % 7 AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS n FROM ({_KEYS}) WHERE NOT contains('adapter_' || (p_partkey % 7), 'adapter_3') GROUP BY ALL")
def weight_shards(spark, d):
    name = F.concat(F.when(C("p_partkey") % 7 == 3, F.lit("Adapter_")).otherwise(F.lit("shard_")), (C("p_partkey") % 7).cast("string"), F.lit(".safetensors"))
    kept = V.weight_keys(_keys(spark, d).withColumn("file", name), "file")
    return kept.groupBy((C("p_partkey") % 7).cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@R.query("nested_category", "SELECT persp_id, trim(coalesce(nullif(granularity_type, ''), nullif(reasoning_type, ''), nullif(source_subset, ''), 'general')) AS category FROM sft_perspective_raw")
def nested_category(spark, d):
    meta = F.struct(C("granularity_type").alias("subfield"), C("reasoning_type").alias("field"), C("source_subset").alias("domain"))
    return table(spark, d, "sft_perspective_raw").select("persp_id", W.nested_pick(meta, ["subfield", "field", "domain"], "general").alias("category"))


@R.query("joined_paths", "SELECT row_id, list_transform(frames, lambda f: CASE WHEN f LIKE '../%' THEN 'data/' || substr(f, 4) ELSE 'data/sft/' || f END) AS paths FROM grpo_rows WHERE len(list_filter(frames, lambda f: f IS NULL OR f = '')) = 0 AND len(frames) > 0")
def joined_paths(spark, d):
    rows = table(spark, d, "grpo_rows").filter("size(frames) > 0 AND NOT exists(frames, f -> f IS NULL OR f = '')")
    return rows.select("row_id", F.transform("frames", lambda f: P.joined_path(f, F.lit("data/./sft"))).alias("paths"))


@R.query("split_map", "SELECT split_name AS split, CAST(count(*) AS BIGINT) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM grpo_rows WHERE split_name IN ('train', 'test') GROUP BY ALL")
def split_map(spark, d):
    g = table(spark, d, "grpo_rows").select("row_id", "split_name")
    parts = {s: g.filter(C("split_name") == s).drop("split_name") for s in ("train", "test")}
    return jsonl.read_configs(parts, "split").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


@R.query("choice_rows", "SELECT raw_id FROM sft_raw WHERE len(list_filter(options, lambda o: trim(o) <> '')) >= 2 AND coalesce(trim(video_path), '') <> ''")
def choice_rows(spark, d):
    from framewright.operators.dispose import choice_rows as kept

    return kept(table(spark, d, "sft_raw").select("raw_id", "options", "video_path"), "options", "video_path").select("raw_id")
