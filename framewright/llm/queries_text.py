"""Queries on the text corpus and on answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.llm import answers, leaks, quality, tokenizer, truncation
from framewright.plans.registry import Registry
from framewright.session import table

R = Registry()


@R.query("p7_ids")
def p7_ids(spark, d):
    return tokenizer.encode_column(table(spark, d, "documents"), "doc_id", "text")


@R.query("p8_found")
def p8_found(spark, d):
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _kinds(spark, d):
    return quality.document_kinds(table(spark, d, "documents"))


@R.query("p9_found")
def p9_found(spark, d):
    return _kinds(spark, d).filter("doc_kind IS NOT NULL").select("doc_id", "doc_kind")


@R.query("p9_statistics")
def p9_statistics(spark, d):
    return _kinds(spark, d)


def _cuts(spark, d):
    return truncation.truncated_records(table(spark, d, "sft_raw"), table(spark, d, "sft_export"))


@R.query("p1_found")
def p1_found(spark, d):
    return _cuts(spark, d).filter("is_cut").select("table_name", "rec_id")


@R.query("p1_sources")
def p1_sources(spark, d):
    return _cuts(spark, d).groupBy("table_name", "source_key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("is_cut").cast("bigint")).alias("n_cut"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("cut_rate"))


@R.query("p4_found")
def p4_found(spark, d):
    return answers.answer_defects(table(spark, d, "sft_raw")).filter("defect IS NOT NULL")


@R.query("p4_report")
def p4_report(spark, d):
    return answers.answer_defects(table(spark, d, "sft_raw")).groupBy("answer_field", "defect").agg(F.count(F.lit(1)).alias("n"))


@R.query("p8_clean")
def p8_clean(spark, d):
    docs = table(spark, d, "documents")
    return leaks.without_leaks(docs, p8_found(spark, d)).select("doc_id", "source", "lang")


@R.query("p8_redacted")
def p8_redacted(spark, d):
    cleaned = leaks.without_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return cleaned.select("doc_id", "n_cuts", F.length("text").alias("n_chars"))


@R.query("p8_report")
def p8_report(spark, d):
    names = table(spark, d, "eval_items").select("item_id", "benchmark_name")
    return p8_found(spark, d).join(names, "item_id").groupBy("benchmark_name").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))


@R.query("p9_report")
def p9_report(spark, d):
    return _kinds(spark, d).groupBy("language", "doc_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance2"), 3).alias("mean_distance2"))


@R.query("p7_lengths")
def p7_lengths(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    sizes = p7_ids(spark, d).select("doc_id", F.size("ids").alias("n"))
    return docs.join(sizes, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("ids"), F.max("n").alias("longest"))
