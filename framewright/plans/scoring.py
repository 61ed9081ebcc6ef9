"""Queries over exported completions: letters, formats, reasoning, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import text as T
from framewright.operators import scoring as S
from framewright.plans import dialect as D
from framewright.plans.registry import Registry
from framewright.session import table

R = Registry()

SCORED = f"""SELECT export_id, sft_mode, lower({D.trim_ws('source_subset')}) AS subset_key,
 {D.choice_letter('output')} AS pred_answer, {D.choice_letter('gold_answer')} AS gt_answer,
 {D.format_ok('output')} AS format_ok, {D.format_class('output')} AS format_class,
 {D.reasoning_type('output')} AS reasoning_kind, {D.reasoning_text('output')} AS reasoning_body,
 {D.n_chars('output')} AS completion_chars, {D.n_words('output')} AS completion_words,
 {D.n_chars(D.reasoning_text('output'))} AS reasoning_chars, {D.n_words(D.reasoning_text('output'))} AS reasoning_words
 FROM sft_export"""

RATES = """CAST(count(*) AS BIGINT) AS n,
 round(coalesce(avg(CAST(pred_answer = gt_answer AS INT)), 0.0), 6) AS answer_accuracy,
 round(coalesce(avg(format_ok), 0.0), 6) AS answer_format_rate,
 round(coalesce(avg(CAST(reasoning_body <> '' AS INT)), 0.0), 6) AS reasoning_present_rate,
 round(coalesce(avg(completion_chars), 0.0), 6) AS avg_completion_chars,
 round(coalesce(avg(completion_words), 0.0), 6) AS avg_completion_words,
 round(coalesce(avg(reasoning_chars), 0.0), 6) AS avg_reasoning_chars,
 round(coalesce(avg(reasoning_words), 0.0), 6) AS avg_reasoning_words"""


def scored(spark, d, letters="A-G"):
    df = table(spark, d, "sft_export").select("export_id", "sft_mode", F.lower(T.trim_ws(F.col("source_subset"))).alias("subset_key"), "output", "gold_answer")
    return S.score_completions(df, "output", "gold_answer", letters)


@R.query("eval_report", f"SELECT {RATES} FROM ({SCORED})")
def eval_report(spark, d):
    return S.eval_report(scored(spark, d))


@R.query("eval_report_by_group", f"SELECT subset_key, sft_mode, {RATES} FROM ({SCORED}) GROUP BY ALL")
def eval_report_by_group(spark, d):
    return S.eval_report(scored(spark, d), ["subset_key", "sft_mode"])


@R.query("score_completions", f"SELECT export_id, pred_answer, gt_answer, CAST(pred_answer = gt_answer AS INT) AS correct, format_ok, format_class, reasoning_kind, completion_chars, completion_words, reasoning_chars, reasoning_words FROM ({SCORED})")
def score_completions(spark, d):
    return scored(spark, d).drop("sft_mode", "subset_key", "output", "gold_answer", "reasoning_body")


@R.query("letter_histogram", f"SELECT pred_answer, gt_answer, CAST(count(*) AS BIGINT) AS n FROM ({SCORED}) GROUP BY ALL")
def letter_histogram(spark, d):
    return S.histogram(scored(spark, d), "pred_answer", "gt_answer")


@R.query("format_class_counts", f"SELECT format_class, reasoning_kind, CAST(count(*) AS BIGINT) AS n FROM ({SCORED}) GROUP BY ALL")
def format_class_counts(spark, d):
    return S.histogram(scored(spark, d), "format_class", "reasoning_kind")


_PIECE = r"[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]".replace("\\\\", "\\")
_COUNTED = f"""SELECT *, CAST(len(regexp_extract_all(coalesce(output, ''), '{_PIECE}')) AS BIGINT) AS completion_tokens, CAST(len(regexp_extract_all(reasoning_body, '{_PIECE}')) AS BIGINT) AS reasoning_tokens
 FROM ({SCORED.replace('FROM sft_export', ', output FROM sft_export')})"""
_MAPS = ["reasoning_kind", "pred_answer", "gt_answer", "format_class"]


def _pieces(c):
    """Words and single signs, as a stand-in for a tokenizer."""
    return F.size(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)))


@R.query("eval_summary", f"""WITH s AS ({_COUNTED}) SELECT sft_mode, {RATES}, round(coalesce(avg(completion_tokens), 0.0), 6) AS avg_completion_tokens, round(coalesce(avg(reasoning_tokens), 0.0), 6) AS avg_reasoning_tokens,
 {", ".join(f"(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT coalesce({m}, 'none') AS v, count(*) AS n FROM s t WHERE t.sft_mode = s.sft_mode GROUP BY ALL)) AS {m}_counts" for m in _MAPS)} FROM s GROUP BY sft_mode""")
def eval_summary(spark, d):
    df = table(spark, d, "sft_export").select("sft_mode", "output", "gold_answer")
    out = S.eval_summary(S.score_completions(df, "output", "gold_answer", tokens=_pieces), ["sft_mode"])
    spelt = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select(*[c for c in out.columns if not c.endswith("_counts")], *[spelt(F.col(f"{m}_counts")).alias(f"{m}_counts") for m in _MAPS])


for _range in T.LETTER_RANGES:
    _name = f"choice_letter_{_range.replace('-', '_').lower()}"

    @R.query(_name, f"SELECT row_id, {D.choice_letter('solution', _range)} AS letter FROM grpo_rows")
    def _letter(spark, d, letters=_range):
        return table(spark, d, "grpo_rows").select("row_id", T.choice_letter(F.col("solution"), letters).alias("letter"))
