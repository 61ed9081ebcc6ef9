"""Scoring of tagged completions and the evaluation report over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import text as T

LENGTHS = ("completion_chars", "completion_words", "completion_tokens", "reasoning_chars", "reasoning_words", "reasoning_tokens")


def score_completions(df: DataFrame, completion: str, solution: str, letters: str = "A-G", tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add prediction, truth, correctness, format, reasoning and length columns. NULL texts count as empty.

    ``tokens`` counts the tokens of a text and adds the two columns of token counts.
    """
    c = F.col(completion)
    r = F.col("reasoning_body")
    sizes = [T.n_chars(c).alias("completion_chars"), T.n_words(c).alias("completion_words"), T.n_chars(r).alias("reasoning_chars"), T.n_words(r).alias("reasoning_words")]
    if tokens:
        sizes += [tokens(F.coalesce(c, F.lit(""))).cast("bigint").alias("completion_tokens"), tokens(r).cast("bigint").alias("reasoning_tokens")]
    # answers first, then their letters, then the comparison, so that no pattern runs twice on a text:
    # the optimiser keeps projections apart whose costly columns are used more than once
    step = df.select("*", T.extract_answer(c).alias("__a"), T.extract_answer(F.col(solution)).alias("__s"), T.reasoning_text(c).alias("reasoning_body"))
    step = step.select("*", T.letter_of(F.col("__a"), letters).alias("pred_answer"), T.letter_of(F.col("__s"), letters).alias("gt_answer"))
    return step.select(
        *df.columns, "pred_answer", "gt_answer",
        (F.col("pred_answer") == F.col("gt_answer")).cast("int").alias("correct"),
        T.format_ok(c).alias("format_ok"),
        T.format_class(c).alias("format_class"),
        T.reasoning_type(c).alias("reasoning_kind"),
        "reasoning_body",
        *sizes,
    )


def _rate(c: Column) -> Column:
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)


def eval_report(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group): count, accuracy, format and reasoning rates, mean lengths, also in tokens where they were counted. All rates are 0.0 over no rows."""
    lengths = [c for c in LENGTHS if c in scored.columns]
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        _rate(F.col("correct")).alias("answer_accuracy"),
        _rate(F.col("format_ok")).alias("answer_format_rate"),
        _rate((F.col("reasoning_body") != "").cast("int")).alias("reasoning_present_rate"),
        *[_rate(F.col(c)).alias(f"avg_{c}") for c in lengths],
    )


def counter_maps(scored: DataFrame, columns: Sequence[str] = ("reasoning_kind", "pred_answer", "gt_answer", "format_class"), by: Sequence[str] = ()) -> DataFrame:
    """One row (per group) with a map of counts of the values of each column; an empty map over no rows, NULL counts as ``none``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns])
    counts = scored.select(*by, F.inline(cells)).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    entry = F.struct("value", "n")
    return counts.groupBy(*by).agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("column") == c, entry)))).alias(f"{c}_counts") for c in columns])


def eval_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The whole report: ``eval_report`` and its counter maps."""
    report, maps = eval_report(scored, by), counter_maps(scored, by=by)
    if not by:
        # both are one row; the key is no constant to the planner, so that it joins by equality
        one = lambda d, c: d.withColumn("__k", F.isnull(c).cast("int"))
        return one(report, "n").join(one(maps, "pred_answer_counts"), "__k", "left").drop("__k")
    on = F.lit(True)
    for k in by:
        on = on & report[k].eqNullSafe(maps[k])
    return report.join(maps, on, "left").select(*[report[c] for c in report.columns], *[maps[c] for c in maps.columns if c not in by])


def histogram(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
