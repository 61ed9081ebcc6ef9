"""One record to several training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import text as T
from framewright.functions.paths import trim_ws
from framewright.operators.dispose import length_reason, perspective_fields, perspective_reason


def length_rows(raw: DataFrame, id_col: str = "raw_id") -> DataFrame:
    """ANSWER, COT and LONG_COT rows of every usable length annotation; missing reasoning gives no row."""
    kept = length_reason(raw).filter("skip_reason IS NULL")
    a, c, lc = (trim_ws(F.coalesce(x, F.lit(""))) for x in ("answer_raw", "cot_raw", "long_cot_raw"))
    tagged = lambda tag, x: F.concat(F.lit(f"<{tag}>\n"), x, F.lit(f"\n</{tag}>"))
    row = lambda depth, cond, out: F.struct(F.lit(depth).alias("reasoning_depth"), F.when(cond, out).alias("output"))
    rows = F.array(
        row("ANSWER", F.lit(True), tagged("ANSWER", a)),
        row("COT", c != "", F.concat(tagged("COT", c), F.lit("\n"), tagged("ANSWER", a))),
        row("LONG_COT", lc != "", F.concat(tagged("LONG_COT", lc), F.lit("\n"), tagged("ANSWER", a))),
    )
    return kept.select(
        id_col,
        T.question_with_options(F.col("question"), F.col("options")).alias("instruction"),
        F.lit("").alias("input"),
        "video_path", "source_subset", "frame_subdir",
        T.plain_answer(F.coalesce(F.nullif("gold_answer", F.lit("")), a)).alias("gold_answer"),
        F.lit("length").alias("sft_mode"),
        F.inline(F.filter(rows, lambda r: r["output"].isNotNull())),
    )


def perspective_rows(raw: DataFrame, id_col: str = "persp_id") -> DataFrame:
    """One row per usable perspective annotation."""
    kept = perspective_reason(perspective_fields(raw)).filter("skip_reason IS NULL")
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>\n"), F.col(c), F.lit(f"\n</{tag}>"))
    out = F.concat_ws("\n", part("REASONING_TYPE", "kind"), part("REASONING", "trace"), part("ANSWER", "answer_text"))
    return kept.select(id_col, "instruction", F.lit("").alias("input"), out.alias("output"), F.col("kind").alias("reasoning_type"), "video_path", "source_subset", "frame_subdir", F.col("answer_text").alias("gold_answer"), F.lit("perspective").alias("sft_mode"))


def targets(df: DataFrame, output: str, formats: list[str], drop_code: bool = True, single: bool = False) -> DataFrame:
    """Target rows (format, target) of the enabled formats a text holds; only the first of them if ``single``."""
    c = F.col(output)
    answer, cot, long_cot = T.tag_block(c, "ANSWER"), T.tag_block(c, "COT"), T.tag_block(c, "LONG_COT")
    made = {"answer": answer, "cot": F.concat(cot, F.lit("\n"), answer), "long_cot": F.concat(long_cot, F.lit("\n"), answer)}
    unknown = set(formats) - set(made)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    rows = F.filter(F.array(*[F.struct(F.lit(f).alias("format"), made[f].alias("target")) for f in formats]), lambda r: r["target"].isNotNull())
    kept = df.filter(~T.has_code_block(c)) if drop_code else df
    return kept.select("*", F.inline(F.slice(rows, 1, 1) if single else rows))


def preprocess_stats(df: DataFrame, fields: Column, output: str, media: Column, formats: list[str], mode: Column, drop_code: bool = True) -> DataFrame:
    """(statistic, n): what became of every row: ``kept_<visual|text>_<format>`` per target, the reasons for skips, ``kept_total``.

    ``fields`` is NULL where instruction or output is missing; ``mode`` is length or perspective. One pass
    makes an array of statistics per row, so a row with several targets counts under each.
    """
    c = F.col(output)
    answer, cot, long_cot = T.tag_block(c, "ANSWER"), T.tag_block(c, "COT"), T.tag_block(c, "LONG_COT")
    there = {"answer": answer.isNotNull(), "cot": cot.isNotNull() & answer.isNotNull(), "long_cot": long_cot.isNotNull() & answer.isNotNull()}
    code = T.has_code_block(c) if drop_code else F.lit(False)
    modality = F.when(media, "kept_visual_").otherwise("kept_text_")
    made = F.filter(F.array(*[F.when(~code & there[f], F.concat(modality, F.lit(f))) for f in formats]), lambda x: x.isNotNull())
    skip = F.array(F.when(code, "skip_code_cot").otherwise("skip_no_matching_format"))
    persp = F.array(F.when(T.perspective_target(c).isNull(), "skip_missing_perspective_tags").otherwise(F.concat(modality, F.lit("perspective"))))
    by_mode = F.when(mode == "perspective", persp).otherwise(F.when(F.size(made) > 0, made).otherwise(skip))
    per_row = F.when(fields.isNull(), F.array(F.lit("skip_missing_fields"))).otherwise(by_mode)
    with_total = F.concat(per_row, F.filter(F.transform(per_row, lambda x: F.when(F.startswith(x, F.lit("kept_")), F.lit("kept_total"))), lambda x: x.isNotNull()))
    return df.select(F.explode(with_total).alias("statistic")).groupBy("statistic").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def repeated(df: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times, numbered from 0."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("gen_idx"))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Add ``batch``: the number of the fixed-size batch of a row in the given order of a dense index."""
    return df.withColumn("batch", F.floor(F.col(order) / size).cast("bigint"))
