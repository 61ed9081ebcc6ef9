import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import mixing, proportions

ROWS = "export_id bigint, sft_mode string, reasoning_depth string, source_subset string, idx int, __n int"
TARGETS = "mix_name string, sft_mode string, reasoning_depth string, source_subset string, target_share double, max_repeats int, size_ratio double"


def pool(spark, n=300):
    # one source holds most rows; names vary in case and blanks; extra columns clash with inner names
    rows = [(i, "length", "COT" if i % 2 else None, (None if i % 50 == 0 else " A " if i % 3 else "b" if i % 7 else "C"), i, i) for i in range(n)]
    return spark.createDataFrame(rows, ROWS)


def test_permutation_and_counts():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    totals = mixing.exact_totals(np.array([0.5, 0.3, 0.2]), 101)
    assert totals.sum() == 101
    counts = mixing.shard_counts(totals, 7, 1)
    assert counts.sum(axis=0).tolist() == totals.tolist() and (counts >= 0).all() and np.ptp(counts.sum(axis=1)) <= 1


def test_mix_shares_repeats_and_reach(spark):
    t = spark.createDataFrame([("m", "length", None, "a", 0.4, 1, 1.0), ("m", "length", None, "B", 0.3, 2, 1.0), ("m", "length", None, "c", 0.2, 1, 1.0), ("m", "length", None, "gone", 0.1, 3, 1.0)], TARGETS)
    mix, report = mixing.mix_sources(pool(spark), t, "export_id")
    rep = {r.source_subset: r for r in report.collect()}
    assert {r.pool_rows for r in rep.values()} == {300}
    rows = mix.collect()
    got = {s: sum(r.source_key == s for r in rows) for s in ("a", "b", "c")}
    assert got == {"a": 120, "b": 90, "c": rep["c"].source_rows}
    assert rep["c"].out_of_reach and rep["gone"].out_of_reach and not rep["a"].out_of_reach
    assert len({r.slot for r in rows}) == len(rows)
    uses = mix.groupBy("source_key", "export_id").count().groupBy("source_key").agg(F.max("count").alias("m")).collect()
    assert all(r.m <= {"a": 1, "b": 2, "c": 1}[r.source_key] for r in uses)
    assert rep["a"].share_reached == pytest.approx(120 / len(rows))
    again = {(r.slot, r.export_id) for r in mixing.mix_sources(pool(spark).repartition(5), t, "export_id")[0].collect()}
    assert again == {(r.slot, r.export_id) for r in rows}


def test_mix_of_nothing(spark):
    t = spark.createDataFrame([("m", "length", None, "a", 1.0, 1, 1.0), (None, None, None, None, None, None, None)], TARGETS).filter("mix_name IS NOT NULL")
    mix, report = mixing.mix_sources(pool(spark).filter("export_id < 0"), t, "export_id")
    assert mix.count() == 0 and [r.out_of_reach for r in report.collect()] == [False]
    mix, report = mixing.mix_sources(pool(spark), t.filter("mix_name = 'x'"), "export_id")
    assert mix.count() == 0 and report.count() == 0


def test_blocks_are_full(spark):
    df = spark.createDataFrame([(i, "w " * (i % 40) if i % 9 else None) for i in range(400)], "id int, text string").withColumn("k", F.lit("x"))
    pieces = mixing.pack_blocks(df, "text", "id", ["k"], block_words=64)
    sizes = {r.block_no: r.n for r in pieces.groupBy("block_no").agg(F.sum("n_words").alias("n")).collect()}
    last = max(sizes)
    assert sorted(sizes) == list(range(last + 1)) and all(n == 64 for b, n in sizes.items() if b != last)
    assert sum(sizes.values()) == sum((i % 40) for i in range(400) if i % 9)


PLAN = "plan_name string, category string, target_share double, min_rows int, sample_fraction double"


def test_sample_matches_targets_and_floors(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else "big" if i % 10 < 8 else " MID" if i % 100 else "x") for i in range(1000)] + [(2000, "tiny"), (2001, "tiny "), (2001, "tiny ")], "row_id int, cat string")
    t = spark.createDataFrame([("p", "Big", 0.6, 5, 0.5), ("p", "mid", 0.3, 5, 0.5), ("p", "tiny", 0.001, 3, 0.5), ("p", "none", 0.099, 3, 0.5)], PLAN)
    sample, report = proportions.sample_to_targets(df, t, "cat", "row_id")
    rep = {r.category: r for r in report.collect()}
    n = {r.category_key: r["count"] for r in sample.groupBy("category_key").count().collect()}
    assert abs(n["big"] - rep["Big"].wanted) <= 1 and n["tiny"] == 3
    assert n["mid"] == min(rep["mid"].category_rows, n["mid"]) and abs(n["mid"] - rep["mid"].wanted) <= 1
    assert rep["none"].too_few and not rep["Big"].too_few and rep["tiny"].missed
    assert rep["Big"].table_rows == 1003
    assert {r.drawn for r in rep.values()} == set(n.values()) | {0}


def test_sample_of_nothing(spark):
    df = spark.createDataFrame([], "row_id int, cat string")
    t = spark.createDataFrame([("p", "a", 1.0, 5, 0.5)], PLAN)
    sample, report = proportions.sample_to_targets(df, t, "cat", "row_id")
    assert sample.count() == 0 and [r.too_few for r in report.collect()] == [False]


def test_shards_of_a_large_mix_add_up(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 3)
    totals = [("m", ["a", "b"], [700, 301], [90, 1000], [5, 6], 11)]
    cells = mixing.plan_cells(spark, totals, 64).toPandas()
    assert cells.groupby("source_key").cnt.sum().to_dict() == {"a": 700, "b": 301} and cells.shard.nunique() == 16
    for _, c in cells.groupby("source_key"):
        spans = sorted(zip(c["first"], c["cnt"]))
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    spans = sorted(zip(cells["place"], cells["cnt"]))
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_out_of_reach_follows_from_the_mix(spark, tmp_path, monkeypatch):
    from framewright.llm import queries_sampling as Q

    pool(spark).write.parquet(str(tmp_path / "sft_export.parquet"))
    spark.createDataFrame([("m", "length", None, "a", 0.4, 1, 1.0), ("m", "length", None, "c", 0.6, 1, 1.0)], TARGETS).write.parquet(str(tmp_path / "mix_targets.parquet"))
    assert [tuple(r) for r in Q.p2_found(spark, str(tmp_path)).collect()] == [("m", "c")]
    whole = mixing.slots
    monkeypatch.setattr(mixing, "slots", lambda cells: whole(cells).filter("slot % 2 = 0"))
    assert Q.p2_found(spark, str(tmp_path)).count() == 0


def test_blocks_as_the_rows_of_a_mix(spark):
    rows = spark.createDataFrame([(i, "length", None, "ab"[i % 2], 30 + i % 50) for i in range(600)], "id int, sft_mode string, reasoning_depth string, source_subset string, tokens int")
    keys = ["sft_mode", "reasoning_depth", "source_subset"]
    pieces = mixing.pack_blocks(rows.withColumn("text", F.lit("")), "text", "id", keys, 256, size=F.col("tokens"))
    blocks = mixing.token_blocks(pieces, keys, 256)
    assert blocks.count() == sum(sum(30 + i % 50 for i in range(600) if i % 2 == k) // 256 for k in (0, 1)) == blocks.select("block_id").distinct().count()
    t = spark.createDataFrame([("m", "length", None, "a", 0.75, 2, 1.0), ("m", "length", None, "b", 0.25, 2, 1.0)], TARGETS)
    _, report = mixing.mix_sources(blocks, t, "block_id")
    assert {r.source_subset: round(r.share_reached, 1) for r in report.collect()} == {"a": 0.7, "b": 0.3} or all(abs(r.share_reached - r.target_share) < 0.02 for r in report.collect())


def test_crossings_are_exact_at_any_length():
    from types import SimpleNamespace

    n = 3_000_000_001
    r = SimpleNamespace(plan_name="p", category_key="a", category_rows=n, wanted=n / 3, min_rows=0)
    _, _, rate, base, _, drawn = proportions.plan_rates([r], 1)[0]
    assert abs(drawn - n / 3) <= 1
    at = lambda k: (int(base) + rate * k) // proportions.UNIT
    assert all(at(k + 1) - at(k) in (0, 1) for k in range(n - 2000, n))
