"""Queries over arrays, token kernels and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import arrays as A
from framewright.functions import geometry as G
from framewright.operators import expand as X
from framewright.operators.indexing import dense_index
from framewright.plans.registry import Registry
from framewright.session import table

R = Registry()
C = F.col


def _tokens(spark, d):
    toks = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("bigint") % 7)
    return table(spark, d, "embeddings").select("vec_id", toks.alias("toks"))


_TK = "list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 100) AS BIGINT) % 7)"


@R.query("strided_subsample", "SELECT vec_id, list_transform(embedding[1:64:8][1:8], lambda x: CAST(x AS DOUBLE)) AS xs, list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE)) AS first5 FROM embeddings")
def strided_subsample(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", A.strided(e, 8).alias("xs"), A.head(e, 5).alias("first5"))


@R.query("uniform_frame_indices", """SELECT p_partkey, list_concat(ix, list_transform(range(8 - len(ix)), lambda i: ix[len(ix)])) AS indices FROM
 (SELECT p_partkey, list_sort(list_distinct(list_transform(range(8), lambda i: CAST((i * (p_size - 1)) // 7 AS BIGINT)))) AS ix FROM part)""")
def uniform_frame_indices(spark, d):
    ix = A.uniform_indices(C("p_size"), 8)
    return table(spark, d, "part").select("p_partkey", A.pad_last(ix, 8, F.lit(-1).cast("bigint")).alias("indices"))


@R.query("distinct_in_order", "SELECT row_id, CAST(len(list_distinct(list_filter(list_concat(frames, frames), lambda f: f IS NOT NULL AND f <> ''))) AS BIGINT) AS kept FROM grpo_rows WHERE len(frames) > 0")
def distinct_in_order(spark, d):
    kept = F.array_distinct(F.filter(F.concat("frames", "frames"), lambda f: f.isNotNull() & (f != "")))
    return table(spark, d, "grpo_rows").filter("size(frames) > 0").select("row_id", F.size(kept).cast("bigint").alias("kept"))


@R.query("media_flatten", "SELECT raw_id, list_filter(list_concat(coalesce(frames, CAST([] AS VARCHAR[])), [image, image_path]), lambda f: f IS NOT NULL AND f <> '') AS media FROM sft_raw")
def media_flatten(spark, d):
    nested = F.array(F.coalesce("frames", F.array().cast("array<string>")), F.array("image", "image_path"))
    return table(spark, d, "sft_raw").select("raw_id", F.filter(F.flatten(nested), lambda f: f.isNotNull() & (f != "")).alias("media"))


@R.query("batch_assign", "SELECT batch, CAST(count(*) AS BIGINT) AS n FROM (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS batch FROM part) GROUP BY ALL")
def batch_assign(spark, d):
    df = X.batches(dense_index(table(spark, d, "part").withColumn("__all", F.lit(1)), ["__all"], ["p_partkey"]), "idx", 64)
    return df.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@R.query("repeat_rows", "SELECT s_suppkey, CAST(g AS BIGINT) AS gen_idx FROM supplier, range(8) t(g)")
def repeat_rows(spark, d):
    return X.repeated(table(spark, d, "supplier").select("s_suppkey"), 8).select("s_suppkey", C("gen_idx").cast("bigint").alias("gen_idx"))


@R.query("flatten_generations", f"SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, t[i] AS token FROM (SELECT vec_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT vec_id, {_TK} AS t FROM embeddings))")
def flatten_generations(spark, d):
    return _tokens(spark, d).select("vec_id", F.posexplode("toks").alias("pos", "token")).select("vec_id", C("pos").cast("bigint").alias("pos"), "token")


_POS = "coalesce(list_position(t, 3), 0)"


@R.query("eos_mask", f"SELECT vec_id, list_transform(range(1, len(t) + 1), lambda i: CAST({_POS} = 0 OR i <= {_POS} AS INT)) AS mask FROM (SELECT vec_id, {_TK} AS t FROM embeddings)")
def eos_mask(spark, d):
    return _tokens(spark, d).select("vec_id", A.eos_mask(C("toks"), F.lit(3).cast("bigint")).alias("mask"))


@R.query("pad_truncate", f"""SELECT vec_id, list_concat(list_transform(range(70 - len(t)), lambda i: CAST(-1 AS BIGINT)), t) AS left_padded, list_concat(t, list_transform(range(70 - len(t)), lambda i: CAST(-1 AS BIGINT))) AS right_padded,
 t[len(t) - 9:len(t)] AS last10 FROM (SELECT vec_id, {_TK} AS t FROM embeddings)""")
def pad_truncate(spark, d):
    pad = F.lit(-1).cast("bigint")
    return _tokens(spark, d).select("vec_id", A.pad_left(C("toks"), 70, pad).alias("left_padded"), A.pad_right(C("toks"), 70, pad).alias("right_padded"), A.keep_last(C("toks"), 10).alias("last10"))


@R.query("label_mask", f"SELECT vec_id, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i <= 16 OR t[i] = 0 THEN CAST(-100 AS BIGINT) ELSE t[i] END) AS labels FROM (SELECT vec_id, {_TK} AS t FROM embeddings)")
def label_mask(spark, d):
    return _tokens(spark, d).select("vec_id", A.label_mask(C("toks"), F.lit(16), F.lit(0).cast("bigint")).alias("labels"))


def _logps(spark, d):
    p = F.transform("embedding", lambda x: x.cast("double"))
    r = F.transform("embedding", lambda x: x.cast("double") * 0.9)
    m = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", "label", p.alias("p"), r.alias("r"), m.alias("m"))


_K = "list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) * 0.9::DOUBLE - CAST(x AS DOUBLE)) - (CAST(x AS DOUBLE) * 0.9::DOUBLE - CAST(x AS DOUBLE)) - 1)"
_MASK = "list_transform(embedding, lambda x: CAST(x > 0 AS INT))"


@R.query("kl_k3", f"SELECT vec_id, round(list_sum({_K}), 6) AS kl_sum FROM embeddings")
def kl_k3(spark, d):
    return _logps(spark, d).select("vec_id", F.round(A.total(A.k3_divergence(C("p"), C("r"))), 6).alias("kl_sum"))


@R.query("masked_mean_loss", f"""SELECT round(avg(loss), 6) AS mean_loss, round(avg(kl), 6) AS mean_kl, round(avg(n), 6) AS mean_length FROM (SELECT
 list_sum(list_transform(range(1, 65), lambda i: -(CAST(label AS DOUBLE) - 0.04::DOUBLE * k[i]) * m[i])) / list_sum(m) AS loss, list_sum(list_transform(range(1, 65), lambda i: k[i] * m[i])) / list_sum(m) AS kl, list_sum(m) AS n
 FROM (SELECT label, {_K} AS k, {_MASK} AS m FROM embeddings))""")
def masked_mean_loss(spark, d):
    k = A.k3_divergence(C("p"), C("r"))
    df = _logps(spark, d).select("label", k.alias("k"), "m")
    loss = A.masked_mean(A.token_loss(C("k"), C("label").cast("double"), 0.04), C("m"))
    mean = lambda c: F.round(F.avg(c), 6)
    return df.agg(mean(loss).alias("mean_loss"), mean(A.masked_mean(C("k"), C("m"))).alias("mean_kl"), mean(A.total(F.transform("m", lambda x: x.cast("double")))).alias("mean_length"))


@R.query("log_softmax_gather", """SELECT vec_id, round(e[1 + vec_id % 64] - (mx + ln(list_sum(list_transform(e, lambda v: exp(v - mx))))), 6) AS logp
 FROM (SELECT vec_id, e, list_max(e) AS mx FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))""")
def log_softmax_gather(spark, d):
    return _logps(spark, d).select("vec_id", F.round(A.log_softmax_at(C("p"), (C("vec_id") % 64).cast("int")), 6).alias("logp"))


_W, _H = "CAST(l_quantity * 40 AS BIGINT)", "CAST(l_linenumber * 300 AS BIGINT)"


def _sizes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (C("l_quantity") * 40).cast("bigint").alias("w"), (C("l_linenumber") * 300).cast("bigint").alias("h"))


_S = f"(SELECT l_orderkey, l_linenumber, {_W} AS w, {_H} AS h FROM lineitem)"
_GOAL = "CASE WHEN w * h > 501760 THEN 501760 WHEN w * h < 3136 THEN 3136 ELSE w * h END"


@R.query("resize_bounds", f"""SELECT l_orderkey, l_linenumber, CASE WHEN g = w * h THEN w ELSE greatest(1, CAST(floor(w * sqrt(g / CAST(w * h AS DOUBLE))) AS BIGINT)) END AS new_w,
 CASE WHEN g = w * h THEN h ELSE greatest(1, CAST(floor(h * sqrt(g / CAST(w * h AS DOUBLE))) AS BIGINT)) END AS new_h FROM (SELECT *, {_GOAL} AS g FROM {_S})""")
def resize_bounds(spark, d):
    w, h = G.pixel_bounds(C("w"), C("h"), 501760, 3136)
    return _sizes(spark, d).select("l_orderkey", "l_linenumber", w.alias("new_w"), h.alias("new_h"))


@R.query("max_side", f"""SELECT l_orderkey, l_linenumber, CASE WHEN greatest(w, h) <= 768 THEN w ELSE greatest(1, CAST(floor(w * (768.0::DOUBLE / greatest(w, h))) AS BIGINT)) END AS new_w,
 CASE WHEN greatest(w, h) <= 768 THEN h ELSE greatest(1, CAST(floor(h * (768.0::DOUBLE / greatest(w, h))) AS BIGINT)) END AS new_h FROM {_S}""")
def max_side(spark, d):
    w, h = G.max_side(C("w"), C("h"), 768)
    return _sizes(spark, d).select("l_orderkey", "l_linenumber", w.alias("new_w"), h.alias("new_h"))


@R.query("min_side", f"""SELECT l_orderkey, l_linenumber, CASE WHEN least(w, h) >= 728 THEN w ELSE greatest(728, CAST(round_even(w * (728.0::DOUBLE / least(w, h)), 0) AS BIGINT)) END AS new_w,
 CASE WHEN least(w, h) >= 728 THEN h ELSE greatest(728, CAST(round_even(h * (728.0::DOUBLE / least(w, h)), 0) AS BIGINT)) END AS new_h FROM {_S}""")
def min_side(spark, d):
    w, h = G.min_side(C("w"), C("h"), 728)
    return _sizes(spark, d).select("l_orderkey", "l_linenumber", w.alias("new_w"), h.alias("new_h"))


@R.query("aspect_clamp", f"""SELECT l_orderkey, l_linenumber, nw AS new_w, nh AS new_h, (nw - w) // 2 AS pad_left, (nh - h) // 2 AS pad_top FROM (SELECT *, CASE WHEN x AND w < h THEN greatest(w, lo) ELSE w END AS nw, CASE WHEN x AND w >= h THEN greatest(h, lo) ELSE h END AS nh
 FROM (SELECT *, greatest(w, h) / least(w, h)::DOUBLE > 3 AS x, CAST(ceil(greatest(w, h) / 3.0::DOUBLE) AS BIGINT) AS lo FROM {_S}))""")
def aspect_clamp(spark, d):
    w, h, left, top = G.clamp_aspect(C("w"), C("h"), 3)
    return _sizes(spark, d).select("l_orderkey", "l_linenumber", w.alias("new_w"), h.alias("new_h"), left.alias("pad_left"), top.alias("pad_top"))


@R.query("cache_block_budget", """SELECT p_partkey, least(greatest(need * seqs + 128, need + 32), 3072) AS blocks FROM (SELECT p_partkey, greatest(1, (CAST(p_size AS BIGINT) * 100 + 256 + 15) // 16) AS need, least(greatest(4, CAST(p_size % 50 AS BIGINT)), 32) AS seqs FROM part)""")
def cache_block_budget(spark, d):
    size = C("p_size").cast("bigint")
    return table(spark, d, "part").select("p_partkey", G.cache_blocks(size * 100, F.lit(256), size % 50).alias("blocks"))


@R.query("warning_rate", "SELECT CAST(count(*) AS BIGINT) AS shown FROM part WHERE p_partkey <= 30 OR p_partkey % 200 = 0")
def warning_rate(spark, d):
    return table(spark, d, "part").filter(G.warn_now(C("p_partkey"))).agg(F.count(F.lit(1)).alias("shown"))
