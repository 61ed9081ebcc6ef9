"""Queries over single fields: picks, paths, prompts, answers, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import paths as P
from framewright.functions import rows as R_
from framewright.functions import text as T
from framewright.plans import dialect as D
from framewright.plans.registry import Registry
from framewright.session import table

R = Registry()
C = F.col


@R.query("coalesce_ids", f"""SELECT row_id, coalesce(nullif(question_id, ''), nullif(video_id, '')) AS question_id,
 coalesce({D.blank_to_null('video_id')}, {D.blank_to_null('dataset_name')}, '') AS video_id,
 coalesce({D.blank_to_null('question_category')}, 'unknown') AS category, coalesce(nullif(solution, ''), nullif(problem, ''), '') AS solution FROM grpo_rows""")
def coalesce_ids(spark, d):
    return table(spark, d, "grpo_rows").select(
        "row_id",
        R_.pick_question_id(C("question_id"), C("video_id")).alias("question_id"),
        R_.pick_video_id(C("video_id"), C("dataset_name")).alias("video_id"),
        R_.pick_category(C("question_category")).alias("category"),
        R_.pick_solution(C("solution"), C("problem")).alias("solution"),
    )


@R.query("safe_stem", f"SELECT row_id, {D.safe_stem('video_id')} AS stem FROM grpo_rows")
def safe_stem(spark, d):
    return table(spark, d, "grpo_rows").select("row_id", P.safe_stem(C("video_id")).alias("stem"))


_KEY = f"coalesce(nullif(array_to_string(list_transform({D.parts(D.drop_suffix('video_id'))}, lambda p: {D.safe_stem('p')}), '__'), ''), 'sample')"


@R.query("frame_key", f"SELECT row_id, {_KEY} AS frame_key FROM grpo_rows")
def frame_key(spark, d):
    return table(spark, d, "grpo_rows").select("row_id", P.frame_key(C("video_id")).alias("frame_key"))


_REPO = f"ltrim({D.trim_ws(chr(34) + 'video_id' + chr(34))}, './')"


@R.query("repo_paths", f"""SELECT row_id, coalesce({_REPO}, '') AS repo_path, list_extract({D.parts(_REPO)}, 1) AS first_part,
 list_extract(string_split(video_id, '/'), -1) AS base_name, lower(regexp_extract(list_extract(string_split(video_id, '/'), -1), '[^.](\\.[^.]+)$', 1)) AS suffix FROM grpo_rows""")
def repo_paths(spark, d):
    return table(spark, d, "grpo_rows").select("row_id", P.repo_path(C("video_id")).alias("repo_path"), P.first_part(C("video_id")).alias("first_part"), P.base_name(C("video_id")).alias("base_name"), P.suffix(C("video_id")).alias("suffix"))


_U = D.trim_ws("coalesce(video_id, '')")


@R.query("url_video_path", f"""SELECT row_id, CASE WHEN contains({_U}, '/resolve/main/') THEN ltrim(substr({_U}, strpos({_U}, '/resolve/main/') + 14), '/')
 WHEN contains({_U}, '://') THEN ltrim(regexp_extract({_U}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') ELSE ltrim(regexp_replace({_U}, '[?#].*$', ''), '/') END AS video_path FROM grpo_rows""")
def url_video_path(spark, d):
    return table(spark, d, "grpo_rows").select("row_id", P.video_path(F.lit(None).cast("string"), C("video_id")).alias("video_path"))


_UP = "regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_ST = D.drop_suffix(f"list_extract(string_split(rtrim({_UP}, '/'), '/'), -1)")


@R.query("stable_url_name", f"""SELECT row_id, {D.safe_stem(f"coalesce(nullif({_ST}, ''), nullif(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), 'video')", 'video')} || '_' || substr(sha1(u), 1, 12) AS name
 FROM (SELECT row_id, 'https://host.example/' || coalesce(video_id, '') AS u FROM grpo_rows)""")
def stable_url_name(spark, d):
    url = F.concat(F.lit("https://host.example/"), F.coalesce("video_id", F.lit("")))
    return table(spark, d, "grpo_rows").select("row_id", P.stable_url_name(url).alias("name"))


@R.query("relative_paths", """SELECT raw_id, '../frames/' || frame_subdir AS relative_path FROM sft_raw WHERE frame_subdir IS NOT NULL""")
def relative_paths(spark, d):
    df = table(spark, d, "sft_raw").filter("frame_subdir IS NOT NULL")
    return df.select("raw_id", P.relative_path(F.concat(F.lit("/data/frames/"), "frame_subdir"), F.lit("/data/out")).alias("relative_path"))


@R.query("image_subset", f"""SELECT raw_id, CASE WHEN {D.trim_ws("coalesce(source_subset, '')")} <> '' THEN string_split({D.trim_ws("coalesce(source_subset, '')")}, '/')[1]
 ELSE coalesce(list_extract({D.parts("ltrim(" + D.trim_ws("coalesce(video_path, '')") + ", './')")}, 1), 'unknown_image') END AS image_subset FROM sft_raw""")
def image_subset(spark, d):
    return table(spark, d, "sft_raw").select("raw_id", P.image_subset(C("source_subset"), C("video_path")).alias("image_subset"))


@R.query("wrap_answer", f"""SELECT row_id, '<ANSWER>' || {D.trim_ws(f"(CASE WHEN {D.matches('coalesce(solution, {0})'.format(chr(39) * 2), T.TOLERANT_ANSWER_TAG)} THEN {D.extract('solution', T.TOLERANT_ANSWER_TAG)} ELSE coalesce(solution, '') END)")} || '</ANSWER>' AS answer FROM grpo_rows""")
def wrap_answer(spark, d):
    return table(spark, d, "grpo_rows").select("row_id", T.wrap_answer(C("solution")).alias("answer"))


@R.query("plain_answer", f"SELECT raw_id, {D.plain_answer('answer_raw')} AS answer FROM sft_raw")
def plain_answer(spark, d):
    return table(spark, d, "sft_raw").select("raw_id", T.plain_answer(C("answer_raw")).alias("answer"))


@R.query("format_options", f"SELECT raw_id, {D.options('options')} AS options, {D.options('string_split(array_to_string(options, chr(10)), chr(10))')} AS lines FROM sft_raw")
def format_options(spark, d):
    return table(spark, d, "sft_raw").select("raw_id", T.option_list(C("options")).alias("options"), T.option_lines(F.array_join("options", "\n")).alias("lines"))


@R.query("choices_map", "SELECT p_partkey, ['A. ' || p_name, 'B. ' || p_brand, 'C. ' || p_type] AS choices FROM part")
def choices_map(spark, d):
    m = F.create_map(F.lit("B"), C("p_brand"), F.lit("A"), C("p_name"), F.lit("C"), C("p_type"), F.lit("D"), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", T.option_map(m).alias("choices"))


_BASE = D.trim_ws("coalesce(nullif(question, ''), '')")
_LAB = f"(CASE WHEN b = '' THEN '' WHEN starts_with(lower(b), 'question:') THEN b ELSE 'Question: ' || b END)"


@R.query("normalize_problem", f"""SELECT raw_id, CASE WHEN len(o) = 0 OR len(list_filter(o, lambda x: NOT contains(b, x))) = 0 THEN {_LAB}
 ELSE (CASE WHEN b = '' THEN 'Question:' ELSE {_LAB} END) || chr(10) || 'Options:' || chr(10) || array_to_string(o, chr(10)) END AS problem
 FROM (SELECT raw_id, {_BASE} AS b, {D.options('options')} AS o FROM sft_raw)""")
def normalize_problem(spark, d):
    return table(spark, d, "sft_raw").select("raw_id", T.problem_text(F.lit(""), C("question"), C("options")).alias("problem"))


@R.query("sft_prompt", f"SELECT raw_id, {D.with_options('question', 'options')} AS prompt FROM sft_raw")
def sft_prompt(spark, d):
    return table(spark, d, "sft_raw").select("raw_id", T.question_with_options(C("question"), C("options")).alias("prompt"))


@R.query("user_text", f"SELECT export_id, concat_ws(chr(10) || chr(10), {D.trim_ws('instruction')}, {D.blank_to_null('input')}, 'Answer with one letter.') AS user_text FROM sft_export")
def user_text(spark, d):
    return table(spark, d, "sft_export").select("export_id", T.user_text(C("instruction"), C("input"), F.lit("Answer with one letter.")).alias("user_text"))


@R.query("strip_image_marks", f"SELECT row_id, {D.trim_ws('problem')} AS problem FROM grpo_rows WHERE problem IS NOT NULL")
def strip_image_marks(spark, d):
    marked = F.concat(F.lit("<image 1> "), C("problem"), F.lit(" <image>"))
    return table(spark, d, "grpo_rows").filter("problem IS NOT NULL").select("row_id", T.strip_image_marks(marked).alias("problem"))


@R.query("normalize_space", f"SELECT row_id, {D.norm_space('problem')} AS text FROM grpo_rows")
def normalize_space(spark, d):
    return table(spark, d, "grpo_rows").select("row_id", T.normalize_space(C("problem")).alias("text"))


@R.query("reasoning_blocks", f"""SELECT export_id, {D.reasoning_type('output')} AS kind, {D.reasoning_text('output')} AS body, {D.tag_block('output', 'ANSWER')} AS answer_block,
 {D.tag_block('output', 'REASONING_TYPE')} || chr(10) || {D.tag_block('output', 'REASONING')} || chr(10) || {D.tag_block('output', 'ANSWER')} AS perspective FROM sft_export""")
def reasoning_blocks(spark, d):
    o = C("output")
    return table(spark, d, "sft_export").select("export_id", T.reasoning_type(o).alias("kind"), T.reasoning_text(o).alias("body"), T.tag_block(o, "ANSWER").alias("answer_block"), T.perspective_target(o).alias("perspective"))


@R.query("text_stats", f"SELECT doc_id, {D.n_chars('text')} AS chars, {D.n_words('text')} AS words FROM documents")
def text_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", T.n_chars(C("text")).alias("chars"), T.n_words(C("text")).alias("words"))


_B = "CAST('0x' || substr(sha256('42::' || k), 1, 8) AS BIGINT)"


@R.query("stable_bucket", f"SELECT row_id, k AS stable_key, {_B} AS bucket FROM (SELECT row_id, coalesce(video_id || '::' || question_id, video_id, question_id, '{{}}') AS k FROM grpo_rows)")
def stable_bucket(spark, d):
    k = R_.stable_key(C("video_id"), C("question_id"))
    return table(spark, d, "grpo_rows").select("row_id", k.alias("stable_key"), R_.hash_bucket(k).alias("bucket"))


@R.query("resolve_fields", f"""SELECT export_id, CASE WHEN i <> '' AND o <> '' THEN i WHEN p <> '' AND s <> '' THEN p END AS instruction, CASE WHEN i <> '' AND o <> '' THEN o WHEN p <> '' AND s <> '' THEN s END AS output
 FROM (SELECT export_id, {D.trim_ws("coalesce(instruction, '')")} AS i, {D.trim_ws("CASE WHEN export_id % 3 = 0 THEN '' ELSE coalesce(output, '') END")} AS o, {D.trim_ws("coalesce(frame_subdir, '')")} AS p, {D.trim_ws("coalesce(gold_answer, '')")} AS s FROM sft_export)""")
def resolve_fields(spark, d):
    out = F.when(C("export_id") % 3 == 0, "").otherwise(C("output"))
    none = F.lit(None).cast("string")
    df = table(spark, d, "sft_export").select("export_id", R_.resolve_fields(C("instruction"), C("input"), out, C("frame_subdir"), none, C("gold_answer"), none).alias("f"))
    return df.select("export_id", "f.instruction", "f.output")


RENAMES = [("outer.model.tower.", "tower."), ("model.tower.", "tower.")]


@R.query("key_rename", """SELECT p_partkey, k AS key, CASE WHEN starts_with(k, 'outer.model.tower.') THEN 'tower.' || substr(k, 19) WHEN starts_with(k, 'model.tower.') THEN 'tower.' || substr(k, 13) ELSE k END AS renamed
 FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'outer.model.tower.' WHEN 1 THEN 'model.tower.' ELSE 'model.head.' END || p_brand AS k FROM part)""")
def key_rename(spark, d):
    k = F.concat(F.when(C("p_partkey") % 3 == 0, "outer.model.tower.").when(C("p_partkey") % 3 == 1, "model.tower.").otherwise("model.head."), C("p_brand"))
    return table(spark, d, "part").select("p_partkey", k.alias("key"), R_.rename_prefix(k, RENAMES).alias("renamed"))


@R.query("key_prefix_topk", "SELECT string_split(video_id, '/')[1] AS prefix, CAST(count(*) AS BIGINT) AS n FROM grpo_rows WHERE video_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, prefix LIMIT 24")
def key_prefix_topk(spark, d):
    df = table(spark, d, "grpo_rows").filter("video_id IS NOT NULL").groupBy(F.substring_index("video_id", "/", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return df.orderBy(F.desc("n"), "prefix").limit(24)


@R.query("chat_turns", "SELECT row_id, CAST(coalesce(least(len(frames), 8), 0) AS BIGINT) AS n_images, CAST(2 AS BIGINT) AS n_turns, problem AS text FROM grpo_rows")
def chat_turns(spark, d):
    n = F.coalesce(F.least(F.size("frames"), F.lit(8)), F.lit(0))
    turns = R_.rebuild_places(R_.chat_turns("Answer the question.", C("problem"), F.lit(3)), n, C("problem"))
    df = table(spark, d, "grpo_rows").select("row_id", "problem", turns.alias("user"), R_.chat_turns("Answer the question.", C("problem"), n).alias("turns"))
    images = F.size(F.filter(C("user.content"), lambda c: c["type"] == "image"))
    return df.select("row_id", images.cast("bigint").alias("n_images"), F.size("turns").cast("bigint").alias("n_turns"), F.element_at(C("user.content"), -1)["text"].alias("text"))
