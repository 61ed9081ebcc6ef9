"""Queries over lookups, memo joins, media cascades and expansions."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import paths as P
from framewright.functions.paths import drop_suffix
from framewright.operators import expand as X
from framewright.operators import resolve as V
from framewright.plans import dialect as D
from framewright.plans.filters import _ANS, _KINDQ, _LEN, _TRACE, PERSP
from framewright.plans.registry import Registry
from framewright.session import table
from framewright.sources import files, jsonl

R = Registry()
C = F.col

_CAT = "(SELECT name, min(path) AS path FROM media_catalogue WHERE name IS NOT NULL AND path IS NOT NULL GROUP BY name)"
_TRY = """(SELECT row_id, 0 AS prio, 'path' AS how, video_id AS key, 'video_id' AS matched_by FROM grpo_rows
 UNION ALL SELECT row_id, 1, 'path', 'media/' || ltrim(video_id, '/'), 'video_id' FROM grpo_rows
 UNION ALL SELECT row_id, 2, 'name', list_extract(string_split(video_id, '/'), -1), 'video_id' FROM grpo_rows
 UNION ALL SELECT row_id, 100, 'path', question_id, 'question_id' FROM grpo_rows
 UNION ALL SELECT row_id, 101, 'path', 'media/' || ltrim(question_id, '/'), 'question_id' FROM grpo_rows
 UNION ALL SELECT row_id, 102, 'name', list_extract(string_split(question_id, '/'), -1), 'question_id' FROM grpo_rows)"""
_LOOK = f"""SELECT g.row_id, m.path, m.matched_by FROM grpo_rows g LEFT JOIN (SELECT row_id, path, matched_by FROM (
 SELECT t.row_id, k.path, t.matched_by, row_number() OVER (PARTITION BY t.row_id ORDER BY t.prio, k.path) AS rn FROM {_TRY} t
 JOIN (SELECT DISTINCT 'path' AS how, path AS key, path FROM media_catalogue WHERE path IS NOT NULL UNION ALL SELECT 'name', name, path FROM {_CAT}) k ON t.how = k.how AND t.key = k.key WHERE t.key <> '') WHERE rn = 1) m ON g.row_id = m.row_id"""


def _lookup(spark, d):
    rows = table(spark, d, "grpo_rows").select("row_id", "video_id", "question_id")
    return V.priority_lookup(rows, "row_id", [("video_id", C("video_id")), ("question_id", C("question_id"))], table(spark, d, "media_catalogue"), ["media"])


@R.query("priority_path_lookup", _LOOK)
def priority_path_lookup(spark, d):
    return _lookup(spark, d)


@R.query("missing_media_counts", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(path) AS BIGINT) AS found, CAST(count(*) - count(path) AS BIGINT) AS missing FROM ({_LOOK})")
def missing_media_counts(spark, d):
    n = F.count(F.lit(1))
    return _lookup(spark, d).agg(n.alias("n_rows"), F.count("path").alias("found"), (n - F.count("path")).alias("missing"))


@R.query("media_catalogue", f"SELECT name, path FROM {_CAT}")
def media_catalogue(spark, d):
    return V.catalogue(table(spark, d, "media_catalogue"))


@R.query("media_catalogue_by_suffix", "SELECT name, min(path) AS path FROM media_catalogue WHERE lower(coalesce(suffix, '')) IN ('.mp4', '.mkv') AND name IS NOT NULL AND path IS NOT NULL GROUP BY name")
def media_catalogue_by_suffix(spark, d):
    return V.catalogue(table(spark, d, "media_catalogue"), [".mp4", ".mkv"])


@R.query("memo_join_first_wins", """SELECT g.row_id, f.subdir FROM grpo_rows g LEFT JOIN (SELECT video_id, dataset_name || '/' || coalesce(question_category, '') AS subdir FROM (
 SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY row_id) AS rn FROM grpo_rows WHERE video_id IS NOT NULL) WHERE rn = 1) f ON g.video_id = f.video_id""")
def memo_join_first_wins(spark, d):
    rows = table(spark, d, "grpo_rows").select("row_id", "video_id", "dataset_name", "question_category")
    made = F.concat("dataset_name", F.lit("/"), F.coalesce("question_category", F.lit("")))
    return V.memo_join(rows, "video_id", ["row_id"], "subdir", made).select("row_id", "subdir")


@R.query("url_memo", """SELECT g.row_id, s.local_name FROM grpo_rows g LEFT JOIN (SELECT DISTINCT video_id, 'clip_' || substr(sha1(video_id), 1, 12) AS local_name FROM grpo_rows WHERE contains(video_id, '://')) s ON g.video_id = s.video_id""")
def url_memo(spark, d):
    rows = table(spark, d, "grpo_rows").select("row_id", "video_id")
    made = F.when(F.contains("video_id", F.lit("://")), F.concat(F.lit("clip_"), F.substring(F.sha1("video_id"), 1, 12)))
    return V.memo_join(rows, "video_id", ["row_id"], "local_name", made).select("row_id", "local_name")


def _sft_files(spark, d):
    """Known paths: media of the perspective annotations, and the clips."""
    p = table(spark, d, "sft_perspective_raw")
    media = p.select(F.explode("frames").alias("f")).unionByName(p.select(C("image").alias("f"))).filter("f <> ''").select(P.joined_path(C("f"), F.lit("sft")).alias("path"))
    return media.unionByName(table(spark, d, "media_catalogue").filter("path IS NOT NULL").select("path")).distinct()


_SFT_FILES = """SELECT DISTINCT path FROM (SELECT CASE WHEN f LIKE '../%' THEN substr(f, 4) ELSE 'sft/' || f END AS path FROM (SELECT unnest(frames) AS f FROM sft_perspective_raw UNION ALL SELECT image FROM sft_perspective_raw) WHERE f <> ''
 UNION ALL SELECT path FROM media_catalogue WHERE path IS NOT NULL)"""
_LISTS = "SELECT regexp_replace(path, '/[^/]*$', '') AS directory, list_sort(list(DISTINCT path) FILTER (regexp_matches(lower(path), '[^/.][.](jpg|jpeg|png)$'))) AS frames FROM ({}) WHERE contains(path, '/') GROUP BY ALL"


@R.query("frame_list_agg", f"SELECT directory, coalesce(frames, CAST([] AS VARCHAR[])) AS frames FROM ({_LISTS.format(_SFT_FILES)})")
def frame_list_agg(spark, d):
    return files.frame_lists(_sft_files(spark, d))


_BELOW = "CASE WHEN {0} LIKE '../%' THEN substr({0}, 4) ELSE 'sft/' || {0} END"


@R.query("sft_media_cascade", f"""WITH files AS ({_SFT_FILES}), lists AS ({_LISTS.format('SELECT path FROM files')}),
 item AS (SELECT raw_id, i, {_BELOW.format('f')} AS low, f FROM (SELECT raw_id, i, trim(frames[i]) AS f FROM (SELECT raw_id, frames, unnest(range(1, len(frames) + 1)) AS i FROM sft_raw)) WHERE f <> ''),
 own AS (SELECT raw_id, list(p ORDER BY i) AS frames FROM (SELECT raw_id, i, CASE WHEN low IN (SELECT path FROM files) THEN low WHEN f IN (SELECT path FROM files) THEN f END AS p FROM item) WHERE p IS NOT NULL GROUP BY ALL),
 sub AS (SELECT raw_id, frames FROM (SELECT raw_id, l.frames, row_number() OVER (PARTITION BY raw_id ORDER BY prio) AS rn FROM (SELECT raw_id, prio, 'frames/' || s || trim(frame_subdir) AS directory FROM sft_raw, (VALUES (0, ''), (1, 'train/'), (2, 'test/')) v(prio, s) WHERE trim(frame_subdir) <> '') JOIN lists l USING (directory) WHERE len(l.frames) > 0) WHERE rn = 1),
 one AS (SELECT raw_id, image FROM (SELECT raw_id, p AS image, row_number() OVER (PARTITION BY raw_id ORDER BY prio) AS rn FROM (SELECT raw_id, prio, CASE WHEN {_BELOW.format('f')} IN (SELECT path FROM files) THEN {_BELOW.format('f')} WHEN f IN (SELECT path FROM files) THEN f END AS p
  FROM (SELECT raw_id, 0 AS prio, trim(image) AS f FROM sft_raw UNION ALL SELECT raw_id, 1, trim(image_path) FROM sft_raw UNION ALL SELECT raw_id, 2, 'media/' || trim(video_path) FROM sft_raw WHERE trim(video_path) <> '') WHERE f <> '') WHERE p IS NOT NULL) WHERE rn = 1)
 SELECT r.raw_id, list_transform(coalesce(own.frames, sub.frames)[1:3], lambda p: '../../' || p) AS frames, CASE WHEN own.frames IS NULL AND sub.frames IS NULL THEN '../../' || one.image END AS image
 FROM sft_raw r LEFT JOIN own USING (raw_id) LEFT JOIN sub USING (raw_id) LEFT JOIN one USING (raw_id)""")
def sft_media_cascade(spark, d):
    rows = table(spark, d, "sft_raw").select("raw_id", "frames", "frame_subdir", "image", "image_path", "video_path")
    singles = [C("image"), C("image_path"), F.when(F.trim("video_path") != "", F.concat(F.lit("media/"), F.trim("video_path")))]
    return V.sft_media_cascade(rows, "raw_id", _sft_files(spark, d), frames=C("frames"), subdir=C("frame_subdir"), singles=singles, root="frames", base="sft", out_dir="sft/out", most=3)


def _grpo_files(spark, d):
    """Known paths: the frames of training rows, of each data set's clips below one split, and of the clips of the catalogue by stem."""
    g = table(spark, d, "grpo_rows")
    listed = g.filter("split_name = 'train'").select(F.explode("frames").alias("f")).filter("f <> ''").select(P.joined_path(C("f"), F.lit("eval")).alias("path"))
    by_name = g.filter("split_name = 'val'").select(F.concat(F.lit("frames/val/"), "dataset_name", F.lit("/frame_000.jpg")).alias("path"))
    stems = table(spark, d, "media_catalogue").filter("name IS NOT NULL").select(F.concat(F.lit("frames/test/"), P.safe_stem(P.drop_suffix(C("name"))), F.lit("/frame_000.png")).alias("path"))
    return listed.unionByName(by_name).unionByName(stems).distinct()


_GRPO_FILES = f"""SELECT DISTINCT path FROM (SELECT CASE WHEN f LIKE '../%' THEN substr(f, 4) ELSE 'eval/' || f END AS path FROM (SELECT unnest(frames) AS f FROM grpo_rows WHERE split_name = 'train') WHERE f <> ''
 UNION ALL SELECT 'frames/val/' || dataset_name || '/frame_000.jpg' FROM grpo_rows WHERE split_name = 'val' UNION ALL SELECT 'frames/test/' || {D.safe_stem(D.drop_suffix('name'))} || '/frame_000.png' FROM media_catalogue WHERE name IS NOT NULL)"""


@R.query("frame_cascade", f"""WITH files AS ({_GRPO_FILES}), lists AS ({_LISTS.format('SELECT path FROM files')}),
 item AS (SELECT row_id, i, CASE WHEN f LIKE '../%' THEN substr(f, 4) ELSE 'eval/' || f END AS p0, CASE WHEN f LIKE '../%' THEN substr(f, 4) ELSE 'frames/' || f END AS p1, f FROM (SELECT row_id, i, trim(frames[i]) AS f FROM (SELECT row_id, frames, unnest(range(1, len(frames) + 1)) AS i FROM grpo_rows)) WHERE f <> ''),
 own AS (SELECT row_id, list_sort(list(p)) AS frames FROM (SELECT row_id, CASE WHEN p0 IN (SELECT path FROM files) THEN p0 WHEN p1 IN (SELECT path FROM files) THEN p1 WHEN f IN (SELECT path FROM files) THEN f END AS p FROM item) WHERE p IS NOT NULL GROUP BY ALL),
 tried AS (SELECT row_id, 1 AS prio, 'frames/' || split_name || '/' || dataset_name AS directory FROM grpo_rows UNION ALL SELECT row_id, 2, 'frames/' || split_name || '/' || {D.safe_stem(D.drop_suffix("list_extract(string_split(nullif(trim(video_id), ''), '/'), -1)"))} FROM grpo_rows WHERE trim(video_id) <> ''),
 sub AS (SELECT row_id, frames FROM (SELECT row_id, coalesce(l.frames, CAST([] AS VARCHAR[])) AS frames, row_number() OVER (PARTITION BY row_id ORDER BY prio) AS rn FROM tried JOIN lists l USING (directory)) WHERE rn = 1)
 SELECT g.row_id, coalesce(own.frames, sub.frames, CAST([] AS VARCHAR[])) AS frames FROM grpo_rows g LEFT JOIN own USING (row_id) LEFT JOIN sub USING (row_id)""")
def frame_cascade(spark, d):
    rows = table(spark, d, "grpo_rows").select("row_id", "frames", "split_name", "dataset_name", "video_id")
    none = F.lit(None).cast("string")
    return V.frame_cascade(rows, "row_id", _grpo_files(spark, d), lists=[C("frames")], frame_dir=none, split=C("split_name"), subdir=C("dataset_name"), video_id=C("video_id"), root="frames", base="eval")


@R.query("pending_media", "SELECT DISTINCT video_path FROM sft_raw r WHERE video_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM media_catalogue m WHERE m.path = 'media/' || r.video_path)")
def pending_media(spark, d):
    done = table(spark, d, "media_catalogue").filter("path IS NOT NULL").select(F.regexp_replace("path", "^media/", "").alias("video_path"))
    return V.pending(table(spark, d, "sft_raw").filter("video_path IS NOT NULL").select("video_path").distinct(), done, "video_path")


@R.query("existing_media", "SELECT raw_id FROM sft_raw r WHERE EXISTS (SELECT 1 FROM media_catalogue m WHERE m.path = 'media/' || r.video_path)")
def existing_media(spark, d):
    rows = table(spark, d, "sft_raw").select("raw_id", F.concat(F.lit("media/"), "video_path").alias("path"))
    return rows.join(table(spark, d, "media_catalogue").select("path"), "path", "left_semi").select("raw_id")


@R.query("existence_probe", "SELECT EXISTS (SELECT 1 FROM media_catalogue WHERE suffix = '.mp4') AS any_found")
def existence_probe(spark, d):
    one = table(spark, d, "media_catalogue").filter("suffix = '.mp4'").limit(1)
    return one.agg((F.count(F.lit(1)) > 0).alias("any_found"))


@R.query("positional_zip", "SELECT row_id, i - 1 AS pos, frames[i] AS frame, 'frame_' || lpad(CAST(i - 1 AS VARCHAR), 3, '0') || '.jpg' AS name FROM (SELECT row_id, frames, unnest(range(1, len(frames) + 1)) AS i FROM grpo_rows WHERE len(frames) > 0)")
def positional_zip(spark, d):
    rows = table(spark, d, "grpo_rows").filter("size(frames) > 0")
    names = F.transform(F.sequence(F.lit(0), F.size("frames") - 1), lambda i: F.format_string("frame_%03d.jpg", i))
    return rows.select("row_id", F.posexplode(F.arrays_zip(C("frames").alias("frame"), names.alias("name"))).alias("pos", "z")).select("row_id", C("pos").cast("bigint").alias("pos"), "z.frame", "z.name")


@R.query("union_sources", "SELECT 'length' AS source, raw_id AS id, question, question_lang FROM sft_raw UNION ALL SELECT 'perspective', persp_id, question, NULL FROM sft_perspective_raw")
def union_sources(spark, d):
    a = table(spark, d, "sft_raw").select(C("raw_id").alias("id"), "question", "question_lang")
    b = table(spark, d, "sft_perspective_raw").select(C("persp_id").alias("id"), "question")
    return jsonl.read_configs({"length": a, "perspective": b}, "source")


_A, _CT, _LC = (D.trim_ws(f"coalesce({c}, '')") for c in ("answer_raw", "cot_raw", "long_cot_raw"))
_NL = "chr(10)"
_AB = f"'<ANSWER>' || {_NL} || a || {_NL} || '</ANSWER>'"
LENGTH = f"""WITH k AS (SELECT raw_id, {D.with_options('question', 'options')} AS instruction, {_A} AS a, {_CT} AS c, {_LC} AS l, {D.plain_answer(f"coalesce(nullif(gold_answer, ''), {_A})")} AS gold_answer FROM sft_raw WHERE ({_LEN}) IS NULL)
 SELECT raw_id, instruction, gold_answer, 'ANSWER' AS reasoning_depth, {_AB} AS output FROM k
 UNION ALL SELECT raw_id, instruction, gold_answer, 'COT', '<COT>' || {_NL} || c || {_NL} || '</COT>' || {_NL} || {_AB} FROM k WHERE c <> ''
 UNION ALL SELECT raw_id, instruction, gold_answer, 'LONG_COT', '<LONG_COT>' || {_NL} || l || {_NL} || '</LONG_COT>' || {_NL} || {_AB} FROM k WHERE l <> ''"""


@R.query("sft_length_expand", LENGTH)
def sft_length_expand(spark, d):
    return X.length_rows(table(spark, d, "sft_raw")).select("raw_id", "instruction", "gold_answer", "reasoning_depth", "output")


@R.query("sft_perspective_export", f"""SELECT persp_id, {D.with_options('question', 'options')} AS instruction, {_KINDQ} AS reasoning_type, {_ANS} AS gold_answer,
 '<REASONING_TYPE>' || {_NL} || {_KINDQ} || {_NL} || '</REASONING_TYPE>' || {_NL} || '<REASONING>' || {_NL} || {_TRACE} || {_NL} || '</REASONING>' || {_NL} || '<ANSWER>' || {_NL} || {_ANS} || {_NL} || '</ANSWER>' AS output
 FROM sft_perspective_raw WHERE ({PERSP}) IS NULL""")
def sft_perspective_export(spark, d):
    return X.perspective_rows(table(spark, d, "sft_perspective_raw")).select("persp_id", "instruction", "reasoning_type", "gold_answer", "output")


_T = f"""(SELECT export_id, 1 AS o, 'answer' AS format, {D.tag_block('output', 'ANSWER')} AS target FROM sft_export UNION ALL
 SELECT export_id, 2, 'cot', {D.tag_block('output', 'COT')} || chr(10) || {D.tag_block('output', 'ANSWER')} FROM sft_export UNION ALL
 SELECT export_id, 3, 'long_cot', {D.tag_block('output', 'LONG_COT')} || chr(10) || {D.tag_block('output', 'ANSWER')} FROM sft_export)"""


@R.query("target_expand", f"SELECT export_id, format, target FROM {_T} WHERE target IS NOT NULL")
def target_expand(spark, d):
    return X.targets(table(spark, d, "sft_export").select("export_id", "output"), "output", ["answer", "cot", "long_cot"]).select("export_id", "format", "target")


@R.query("target_single", f"SELECT export_id, format, target FROM (SELECT *, row_number() OVER (PARTITION BY export_id ORDER BY -o) AS rn FROM {_T} WHERE target IS NOT NULL) WHERE rn = 1")
def target_single(spark, d):
    return X.targets(table(spark, d, "sft_export").select("export_id", "output"), "output", ["long_cot", "cot", "answer"], single=True).select("export_id", "format", "target")


@R.query("frame_directories", f"SELECT {D.drop_suffix('path')} AS directory, CAST(count(*) AS BIGINT) AS n FROM media_catalogue WHERE path IS NOT NULL GROUP BY ALL")
def frame_directories(spark, d):
    return table(spark, d, "media_catalogue").filter("path IS NOT NULL").groupBy(drop_suffix(C("path")).alias("directory")).agg(F.count(F.lit(1)).alias("n"))
