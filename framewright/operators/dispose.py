"""Dispositions: one column says what becomes of a row, so filters and counters share one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.paths import trim_ws
from framewright.functions.rows import reasoning_label
from framewright.functions.text import option_list, plain_answer, question_with_options

# Reasoning types that are kept.
REASONING_TYPES = ["ABSTRACT", "TEMPORAL", "SPATIOTEMPORAL"]


def is_choice(options: Column, kind: Column) -> Column:
    """Two options or more, or a type that names both ``multiple`` and ``choice``."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return (F.coalesce(F.size(options), F.lit(0)) >= 2) | (F.contains(k, F.lit("multiple")) & F.contains(k, F.lit("choice")))


def is_choice_list(options: Column) -> Column:
    return F.coalesce(F.size(options), F.lit(0)) >= 2


def is_choice_label(kind: Column) -> Column:
    return F.lower(trim_ws(F.coalesce(kind, F.lit("")))) == "multiple-choice"


def match_subset(subsets: list[str], *candidates: Column) -> Column:
    """First subset of the list that a candidate equals or lies under; NULL if none."""
    out = F.lit(None).cast("string")
    for s in reversed(subsets):
        hit = F.lit(False)
        for c in candidates:
            hit = hit | F.coalesce((c == s) | F.startswith(c, F.lit(s + "/")), F.lit(False))
        out = F.when(hit, F.lit(s)).otherwise(out)
    return out


def media_disposition(media: Column, subset: Column, choice: Column, include_images: bool) -> Column:
    """kept_video, kept_image, dropped (a clip outside the subsets), skipped_unsupported or skipped_not_choice."""
    image = (media == "image") if include_images else F.lit(False)
    return (
        F.when((media == "video") & subset.isNull(), "dropped")
        .when(~((media == "video") | image) | media.isNull(), "skipped_unsupported")
        .when(~choice, "skipped_not_choice")
        .otherwise(F.concat(F.lit("kept_"), media))
    )


def has_media(df_frames: Column, image: Column, image_path: Column) -> Column:
    return (F.coalesce(F.size(F.filter(df_frames, lambda f: f.isNotNull() & (f != ""))), F.lit(0)) > 0) | (F.coalesce(image, F.lit("")) != "") | (F.coalesce(image_path, F.lit("")) != "")


def length_reason(df: DataFrame) -> DataFrame:
    """Add ``skip_reason`` of length annotations, NULL for those kept; tests in order, the first that fails counts."""
    instruction = question_with_options(F.col("question"), F.col("options"))
    answer = trim_ws(F.coalesce("answer_raw", F.lit("")))
    media = has_media(F.col("frames"), F.col("image"), F.col("image_path"))
    return df.withColumn("skip_reason", F.when(instruction == "", "skip_missing_instruction").when(answer == "", "skip_missing_answer").when(~media, "skip_missing_media"))


def perspective_fields(df: DataFrame) -> DataFrame:
    """Add instruction, kind, trace and answer_text of perspective annotations, resolved over their aliases."""
    trace = trim_ws(F.coalesce(F.nullif("granularity_thinking_raw", F.lit("")), F.nullif("reasoning_raw", F.lit("")), F.nullif("thinking", F.lit("")), F.lit("")))
    return df.select(
        "*",
        question_with_options(F.col("question"), F.col("options")).alias("instruction"),
        reasoning_label(F.col("granularity_type"), F.col("reasoning_type")).alias("kind"),
        trace.alias("trace"),
        F.coalesce(plain_answer(F.coalesce(F.nullif("gold_answer", F.lit("")), F.nullif("answer", F.lit("")), F.lit(""))), F.lit("")).alias("answer_text"),
    )


def perspective_reason(df: DataFrame) -> DataFrame:
    """Add ``skip_reason`` after ``perspective_fields``."""
    image_path = F.col("image_path") if "image_path" in df.columns else F.lit(None).cast("string")
    media = has_media(F.col("frames"), F.col("image"), image_path)
    return df.withColumn(
        "skip_reason",
        F.when(F.col("instruction") == "", "skip_missing_instruction")
        .when(F.col("kind") == "", "skip_missing_reasoning_type")
        .when(~F.col("kind").isin(REASONING_TYPES), "skip_invalid_reasoning_type")
        .when(F.col("trace") == "", "skip_missing_reasoning_trace")
        .when(F.col("answer_text") == "", "skip_missing_answer")
        .when(~media, "skip_missing_media"),
    )


def choice_rows(df: DataFrame, options: str, path: str) -> DataFrame:
    """Rows that have a path and two options or more."""
    return df.filter((F.size(option_list(F.col(options))) >= 2) & (trim_ws(F.coalesce(F.col(path), F.lit(""))) != ""))


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
