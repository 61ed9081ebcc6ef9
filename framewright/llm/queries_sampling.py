"""Queries on mixes and on samples with target proportions."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.llm import mixing, proportions
from framewright.plans.dialect import trim_ws
from framewright.plans.registry import Registry
from framewright.session import cut, table

R = Registry()

POOL = f"""SELECT t.mix_name, t.source_subset, t.target_share, t.max_repeats, t.size_ratio,
 (SELECT count(*) FROM sft_export e WHERE e.sft_mode = t.sft_mode AND (t.reasoning_depth IS NULL OR e.reasoning_depth = t.reasoning_depth)) AS pool_rows,
 (SELECT count(*) FROM sft_export e WHERE e.sft_mode = t.sft_mode AND (t.reasoning_depth IS NULL OR e.reasoning_depth = t.reasoning_depth)
   AND lower({trim_ws('e.source_subset')}) = lower({trim_ws('t.source_subset')})) AS source_rows
 FROM mix_targets t"""


def _mix(spark, d):
    return mixing.mix_sources(table(spark, d, "sft_export"), table(spark, d, "mix_targets"), "export_id")


@R.query("p2_found", f"SELECT mix_name, source_subset FROM ({POOL}) WHERE max_repeats * source_rows < target_share * size_ratio * pool_rows")
def p2_found(spark, d):
    # every row of the source is used as often as it may be, and what the mix holds of it falls short all the same
    return _mix(spark, d)[1].filter("rows_given = source_rows * max_repeats AND rows_given < wanted").select("mix_name", "source_subset")


@R.query("p2_mix")
def p2_mix(spark, d):
    return _mix(spark, d)[0]


@R.query("p2_shares", f"SELECT mix_name, source_subset, target_share, CAST(pool_rows AS BIGINT) AS pool_rows, CAST(source_rows AS BIGINT) AS source_rows, CAST(max_repeats * source_rows AS BIGINT) AS cap, max_repeats * source_rows < target_share * size_ratio * pool_rows AS out_of_reach FROM ({POOL})")
def p2_shares(spark, d):
    return _mix(spark, d)[1].select("mix_name", "source_subset", "target_share", "pool_rows", "source_rows", "cap", "out_of_reach")


@R.query("p2_blocks")
def p2_blocks(spark, d):
    rows = table(spark, d, "sft_export").select("export_id", "output", "sft_mode", mixing.source_key(F.col("source_subset")).alias("source_key"))
    return mixing.pack_blocks(rows, "output", "export_id", ["sft_mode", "source_key"])


#: Tokens of a block, and the texts' vocabulary.
BLOCK_TOKENS = 1024


def _block_mix(spark, d):
    """Mixes of blocks of BLOCK_TOKENS tokens, packed within a mode, depth and source."""
    from framewright.llm import tokenizer

    keys = ["sft_mode", "reasoning_depth", "source_subset"]
    rows = table(spark, d, "sft_export").select("export_id", "output", "sft_mode", "reasoning_depth", mixing.source_key(F.col("source_subset")).alias("source_subset"))
    sizes = tokenizer.encode_column(rows.select("export_id", "output"), "export_id", "output").select("export_id", F.size("ids").alias("tokens"))
    sized = cut(rows.drop("output").join(sizes, "export_id"))
    pieces = mixing.pack_blocks(sized.withColumn("output", F.lit("")), "output", "export_id", keys, BLOCK_TOKENS, size=F.col("tokens"))
    return mixing.mix_sources(mixing.token_blocks(pieces, keys, BLOCK_TOKENS), table(spark, d, "mix_targets"), "block_id")


@R.query("p2_block_shares")
def p2_block_shares(spark, d):
    return _block_mix(spark, d)[1].select("mix_name", "source_subset", "target_share", (F.col("rows_given") * BLOCK_TOKENS).alias("tokens_given"), F.round("share_reached", 6).alias("share_reached"))


def _counts(name: str, field: str) -> str:
    return f"""SELECT t.plan_name, t.category, t.target_share, t.min_rows, t.sample_fraction,
 (SELECT count(*) FROM {name}) AS table_rows,
 (SELECT count(*) FROM {name} x WHERE lower({trim_ws('x.' + field)}) = lower({trim_ws('t.category')})) AS category_rows
 FROM category_targets t WHERE t.table_name = '{name}' AND t.field_name = '{field}'"""


PLANS = (("grpo_rows", "question_category", "row_id"), ("sft_export", "source_subset", "export_id"))
COUNTS = " UNION ALL ".join(_counts(n, f) for n, f, _ in PLANS)


def _samples(spark, d):
    targets = table(spark, d, "category_targets")
    parts = []
    for name, field, id_col in PLANS:
        own = targets.filter((F.col("table_name") == name) & (F.col("field_name") == field))
        sample, report = proportions.sample_to_targets(table(spark, d, name), own, field, id_col)
        parts.append((sample.withColumnRenamed(id_col, "rec_id").select(F.lit(name).alias("table_name"), "*"), report))
    return parts[0][0].unionByName(parts[1][0]), parts[0][1].unionByName(parts[1][1])


@R.query("p3_found", f"SELECT plan_name, category FROM ({COUNTS}) WHERE category_rows < target_share * sample_fraction * table_rows")
def p3_found(spark, d):
    # the sample holds every row of the category and still falls short
    return _samples(spark, d)[1].filter("drawn = category_rows AND drawn < wanted").select("plan_name", "category")


@R.query("p3_sample")
def p3_sample(spark, d):
    return _samples(spark, d)[0]


@R.query("p3_shares", f"SELECT plan_name, category, CAST(table_rows AS BIGINT) AS table_rows, CAST(category_rows AS BIGINT) AS category_rows, category_rows < target_share * sample_fraction * table_rows AS too_few FROM ({COUNTS})")
def p3_shares(spark, d):
    return _samples(spark, d)[1].select("plan_name", "category", "table_rows", "category_rows", "too_few")


_GIVEN = f"""SELECT *, least(part + CASE WHEN row_number() OVER (PARTITION BY mix_name ORDER BY -(raw - part), lower({trim_ws('source_subset')})) <= missing THEN 1 ELSE 0 END, max_repeats * source_rows) AS given
 FROM (SELECT *, round_even(sum(raw) OVER w, 0) - sum(part) OVER w AS missing FROM (SELECT *, floor(raw + 1e-9::DOUBLE) AS part FROM (SELECT *, target_share * round_even(size_ratio * pool_rows, 0) AS raw FROM ({POOL}))) WINDOW w AS (PARTITION BY mix_name))"""


@R.query("p2_report", f"""SELECT mix_name, source_subset, target_share, CAST(given AS BIGINT) AS rows_given, round(coalesce(given / nullif(sum(given) OVER (PARTITION BY mix_name), 0), 0.0), 6) AS share_reached,
 max_repeats * source_rows < target_share * size_ratio * pool_rows AS out_of_reach FROM ({_GIVEN})""")
def p2_report(spark, d):
    return _mix(spark, d)[1].select("mix_name", "source_subset", "target_share", "rows_given", F.round("share_reached", 6).alias("share_reached"), "out_of_reach")


@R.query("p3_report")
def p3_report(spark, d):
    return _samples(spark, d)[1].select("plan_name", "category", "target_share", "min_rows", "drawn", F.round("share_drawn", 6).alias("share_drawn"), "missed")
