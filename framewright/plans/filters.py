"""Queries that dispose of rows and count what became of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import paths as P
from framewright.functions import text as T
from framewright.functions.rows import resolve_fields
from framewright.operators import dispose as S
from framewright.operators import expand as X
from framewright.plans import dialect as D
from framewright.plans.registry import Registry
from framewright.session import table

R = Registry()
C = F.col

_SUBSETS = ["KitchenLoop", "MarketWalk", "LabBench"]
_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'Multiple Choice' WHEN 1 THEN 'multiple-choice' WHEN 2 THEN 'free form' END"


@R.query("choice_filters", f"""SELECT CAST(sum(CAST((p_size % 3) >= 2 OR coalesce({_KIND}, '') ILIKE '%multiple%choice%' AS INT)) AS BIGINT) AS by_type, CAST(sum(CAST((p_size % 3) >= 2 AS INT)) AS BIGINT) AS by_list,
 CAST(sum(CAST(coalesce(lower({_KIND}), '') = 'multiple-choice' AS INT)) AS BIGINT) AS by_label FROM part""")
def choice_filters(spark, d):
    kind = F.when(C("p_partkey") % 4 == 0, "Multiple Choice").when(C("p_partkey") % 4 == 1, "multiple-choice").when(C("p_partkey") % 4 == 2, "free form")
    opts = F.slice(F.array("p_name", "p_brand", "p_type"), 1, C("p_size") % 3)
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    return table(spark, d, "part").agg(n(S.is_choice(opts, kind)).alias("by_type"), n(S.is_choice_list(opts)).alias("by_list"), n(S.is_choice_label(kind)).alias("by_label"))


_P = "ltrim(" + D.trim_ws("coalesce(video_path, '')") + ", './')"


@R.query("subset_match", "SELECT raw_id, CASE " + " ".join(f"WHEN source_subset = '{s}' OR starts_with(source_subset, '{s}/') OR {_P} = '{s}' OR starts_with({_P}, '{s}/') THEN '{s}'" for s in _SUBSETS) + " END AS subset FROM sft_raw")
def subset_match(spark, d):
    return table(spark, d, "sft_raw").select("raw_id", S.match_subset(_SUBSETS, C("source_subset"), P.repo_path(C("video_path"))).alias("subset"))


@R.query("media_gate_counts", f"""SELECT disposition, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN media = 'video' AND subset IS NULL THEN 'dropped' WHEN NOT (media = 'video' OR media = 'image') THEN 'skipped_unsupported'
 WHEN coalesce(len(options), 0) < 2 THEN 'skipped_not_choice' ELSE 'kept_' || media END AS disposition
 FROM (SELECT options, CASE WHEN coalesce(video_path, '') <> '' THEN 'video' WHEN coalesce(image, image_path, '') <> '' THEN 'image' ELSE 'none' END AS media,
  CASE {' '.join(f"WHEN source_subset = '{s}' OR starts_with(source_subset, '{s}/') THEN '{s}'" for s in _SUBSETS)} END AS subset FROM sft_raw)) GROUP BY ALL""")
def media_gate_counts(spark, d):
    media = F.when(F.coalesce("video_path", F.lit("")) != "", "video").when(F.coalesce("image", "image_path", F.lit("")) != "", "image").otherwise("none")
    df = table(spark, d, "sft_raw").select(S.media_disposition(media, S.match_subset(_SUBSETS, C("source_subset")), S.is_choice_list(C("options")), True).alias("disposition"))
    return S.counts_by(df, "disposition")


def _ends(x: str, suffixes: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with(lower({D.trim_ws(x)}), '{s}')" for s in suffixes) + ")"


_MIXED = "coalesce(CASE WHEN row_id % 5 = 0 THEN list_extract(frames, 1) WHEN row_id % 7 = 0 THEN replace(video_id, '.mp4', '.bmp') ELSE video_id END, '')"


@R.query("video_only_filter", f"SELECT row_id, NOT {_ends(_MIXED, P.IMAGE_SUFFIXES)} AS keep_short, NOT {_ends(_MIXED, P.STILL_SUFFIXES)} AS keep_long FROM grpo_rows")
def video_only_filter(spark, d):
    v = F.when(C("row_id") % 5 == 0, F.get("frames", F.lit(0))).when(C("row_id") % 7 == 0, F.replace(C("video_id"), F.lit(".mp4"), F.lit(".bmp"))).otherwise(C("video_id"))
    return table(spark, d, "grpo_rows").select("row_id", (~P.has_suffix(v, P.IMAGE_SUFFIXES)).alias("keep_short"), (~P.has_suffix(v, P.STILL_SUFFIXES)).alias("keep_long"))


@R.query("required_fields", "SELECT row_id FROM grpo_rows WHERE coalesce(video_id, '') <> '' AND coalesce(question_id, '') <> '' AND coalesce(problem, '') <> '' AND coalesce(len(frames), 0) > 0")
def required_fields(spark, d):
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return table(spark, d, "grpo_rows").filter(full("video_id") & full("question_id") & full("problem") & (F.coalesce(F.size("frames"), F.lit(0)) > 0)).select("row_id")


_LEN = f"""CASE WHEN {D.with_options('question', 'options')} = '' THEN 'skip_missing_instruction' WHEN {D.trim_ws("coalesce(answer_raw, '')")} = '' THEN 'skip_missing_answer'
 WHEN NOT {D.has_media('frames', 'image', 'image_path')} THEN 'skip_missing_media' END"""


@R.query("length_skip_counts", f"SELECT {_LEN} AS skip_reason, CAST(count(*) AS BIGINT) AS n FROM sft_raw GROUP BY ALL")
def length_skip_counts(spark, d):
    return S.counts_by(S.length_reason(table(spark, d, "sft_raw")), "skip_reason")


_KINDQ = f"upper({D.trim_ws(chr(99) + 'oalesce(nullif(granularity_type, {0}), nullif(reasoning_type, {0}), {0})'.format(chr(39) * 2))})"
_TRACE = D.trim_ws("coalesce(nullif(granularity_thinking_raw, ''), nullif(reasoning_raw, ''), nullif(thinking, ''), '')")
_ANS = f"coalesce({D.plain_answer('coalesce(nullif(gold_answer, {0}), nullif(answer, {0}), {0})'.format(chr(39) * 2))}, '')"
PERSP = f"""CASE WHEN {D.with_options('question', 'options')} = '' THEN 'skip_missing_instruction' WHEN {_KINDQ} = '' THEN 'skip_missing_reasoning_type'
 WHEN {_KINDQ} NOT IN ('ABSTRACT', 'TEMPORAL', 'SPATIOTEMPORAL') THEN 'skip_invalid_reasoning_type' WHEN {_TRACE} = '' THEN 'skip_missing_reasoning_trace'
 WHEN {_ANS} = '' THEN 'skip_missing_answer' WHEN NOT {D.has_media('frames', 'image', 'NULL')} THEN 'skip_missing_media' END"""


@R.query("perspective_skip_counts", f"SELECT {PERSP} AS skip_reason, CAST(count(*) AS BIGINT) AS n FROM sft_perspective_raw GROUP BY ALL")
def perspective_skip_counts(spark, d):
    return S.counts_by(S.perspective_reason(S.perspective_fields(table(spark, d, "sft_perspective_raw"))), "skip_reason")


@R.query("code_block_filter", f"SELECT export_id FROM sft_export WHERE {D.tag_block('output', 'CODE')} IS NULL AND {D.tag_block('output', 'COT')} IS NOT NULL")
def code_block_filter(spark, d):
    return table(spark, d, "sft_export").filter(~T.has_code_block(C("output")) & T.tag_block(C("output"), "COT").isNotNull()).select("export_id")


@R.query("composite_counts", f"SELECT sft_mode, coalesce(reasoning_depth, '') AS depth, sft_mode || ':' || coalesce(lower({D.trim_ws('source_subset')}), 'unknown') AS media_subset, CAST(count(*) AS BIGINT) AS n FROM sft_export GROUP BY ALL")
def composite_counts(spark, d):
    df = table(spark, d, "sft_export").select("sft_mode", F.coalesce("reasoning_depth", F.lit("")).alias("depth"), F.concat("sft_mode", F.lit(":"), F.coalesce(F.lower(T.trim_ws(C("source_subset"))), F.lit("unknown"))).alias("media_subset"))
    return S.counts_by(df, "sft_mode", "depth", "media_subset")


@R.query("distinct_paths", f"SELECT DISTINCT ltrim({D.trim_ws('video_path')}, './') AS path FROM sft_raw WHERE coalesce(video_path, '') <> ''")
def distinct_paths(spark, d):
    return table(spark, d, "sft_raw").filter("coalesce(video_path, '') <> ''").select(P.repo_path(C("video_path")).alias("path")).distinct()


@R.query("run_summary", """SELECT split_name, CAST(count(*) AS BIGINT) AS rows_in, CAST(count(*) FILTER (coalesce(len(list_filter(frames, lambda f: f IS NOT NULL AND f <> '')), 0) > 0) AS BIGINT) AS rows_out,
 CAST(count(*) FILTER (coalesce(len(list_filter(frames, lambda f: f IS NOT NULL AND f <> '')), 0) = 0) AS BIGINT) AS skipped_no_frames FROM grpo_rows GROUP BY ALL""")
def run_summary(spark, d):
    full = F.coalesce(F.size(F.filter("frames", lambda f: f.isNotNull() & (f != ""))), F.lit(0)) > 0
    return table(spark, d, "grpo_rows").groupBy("split_name").agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(full).alias("rows_out"), F.count_if(~full).alias("skipped_no_frames"))


_MODAL = D.has_media("frames", "image", "NULL")


_TAGS = {t: f"{D.tag_block('output', t)} IS NOT NULL" for t in ("ANSWER", "COT", "LONG_COT", "CODE")}
_PTAGS = " AND ".join("(" + " OR ".join(f"{D.tag_block('output', t)} IS NOT NULL" for t in tags) + ")" for tags in T.PERSPECTIVE_TAGS)
_STATS = f"""WITH r AS (SELECT export_id, sft_mode, {_MODAL} AS visual, {D.trim_ws("coalesce(instruction, '')")} <> '' AND {D.trim_ws("coalesce(output, '')")} <> '' AS ok, {_TAGS['ANSWER']} AS a, {_TAGS['COT']} AS c, {_TAGS['LONG_COT']} AS l, {_TAGS['CODE']} AS code, {_PTAGS} AS p FROM sft_export),
 k AS (SELECT CASE WHEN visual THEN 'kept_visual_' ELSE 'kept_text_' END || f AS statistic FROM r, (VALUES ('answer'), ('cot'), ('long_cot'), ('perspective')) v(f)
  WHERE ok AND CASE WHEN sft_mode = 'perspective' THEN f = 'perspective' AND p ELSE NOT code AND CASE f WHEN 'answer' THEN a WHEN 'cot' THEN c AND a WHEN 'long_cot' THEN l AND a ELSE false END END)
 SELECT statistic, CAST(count(*) AS BIGINT) AS n FROM (SELECT statistic FROM k UNION ALL SELECT 'kept_total' FROM k UNION ALL
 SELECT CASE WHEN NOT ok THEN 'skip_missing_fields' WHEN sft_mode = 'perspective' THEN 'skip_missing_perspective_tags' WHEN code THEN 'skip_code_cot' ELSE 'skip_no_matching_format' END FROM r
  WHERE NOT ok OR CASE WHEN sft_mode = 'perspective' THEN NOT p ELSE code OR NOT a END) GROUP BY ALL"""


@R.query("preprocess_stats", _STATS)
def preprocess_stats(spark, d):
    none = F.lit(None).cast("string")
    ok = resolve_fields(C("instruction"), C("input"), C("output"), none, none, none, none)
    return X.preprocess_stats(table(spark, d, "sft_export"), ok, "output", S.has_media(C("frames"), C("image"), none), ["answer", "cot", "long_cot"], C("sft_mode"))
