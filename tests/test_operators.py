import pytest
from pyspark.sql import functions as F

from framewright.operators import dispose, expand, resolve, rewards, sampling, scoring
from framewright.operators.indexing import dense_index


def test_dense_index_is_a_permutation_within_groups(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"))
    got = dense_index(df, ["g"], ["id"], bits=3).collect()
    for g in ("a", "b", None):
        own = sorted(r.idx for r in got if r.g == g)
        assert own == list(range(len(own))) and len(own) > 100
    again = {(r.id, r.idx) for r in dense_index(df.repartition(7), ["g"], ["id"], bits=3).collect()}
    assert again == {(r.id, r.idx) for r in got}
    assert dense_index(df.filter("id < 0"), ["g"], ["id"]).count() == 0


def test_stratified_counts_are_exact(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 9 else "d") for i in range(10)] + [(10, None)], "id int, s string")
    n = {r.s: r["count"] for r in sampling.stratified_sample(df, ["s"], 0.5, ["id"]).groupBy("s").count().collect()}
    assert n == {"a": 2, "b": 2, "c": 2, "d": 1, None: 1}
    assert sampling.stratified_sample(df, ["s"], 1, ["id"]).count() == 11
    with pytest.raises(ValueError):
        sampling.global_sample(df, 0, ["id"])


@pytest.mark.parametrize("n,fraction,want", [(2, 0.05, 1), (10, 1.0, 9), (100, 0.05, 5)])
def test_head_split(spark, n, fraction, want):
    assert sampling.head_split(spark.range(n), fraction, ["id"]).filter("split = 'eval'").count() == want


def test_head_split_needs_two_rows(spark):
    with pytest.raises(Exception, match="two rows"):
        sampling.head_split(spark.range(1), 0.5, ["id"]).collect()


def test_hash_split_is_stable(spark):
    df = spark.range(2000)
    a = {(r.id, r.split) for r in sampling.hash_split(df, F.col("id").cast("string"), 0.1).collect()}
    b = {(r.id, r.split) for r in sampling.hash_split(df.repartition(9).orderBy(F.desc("id")), F.col("id").cast("string"), 0.1).collect()}
    assert a == b and 120 < sum(s == "eval" for _, s in a) < 280


def test_advantage(spark):
    rows = [(1, 1.0), (1, 0.0), (2, 0.5), (2, 0.5), (3, 1.0)]
    got = rewards.group_advantage(spark.createDataFrame(rows, "g int, reward double"), ["g"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r.advantage)
    assert abs(sum(by[1])) < 1e-9 and by[2] == [0.0, 0.0] and by[3] == [None]


def test_reward_weights():
    assert rewards.resolve_weights(["accuracy", "format"], [1.0, 0.0], {"format": 0.5}) == {"accuracy": 1.0, "format": 0.5}
    with pytest.raises(ValueError):
        rewards.resolve_weights(["accuracy"], named={"other": 1.0})


def test_eval_report_of_nothing(spark):
    df = spark.createDataFrame([], "c string, s string")
    r = scoring.eval_report(scoring.score_completions(df, "c", "s")).first()
    assert r.n == 0 and r.answer_accuracy == 0.0 and r.avg_reasoning_words == 0.0


def test_choice_and_subsets(spark):
    df = spark.createDataFrame([(["a"], "Multiple Choice"), (["a", "b"], "x"), (None, None)], "o array<string>, k string")
    assert [r[0] for r in df.select(dispose.is_choice(F.col("o"), F.col("k"))).collect()] == [True, True, False]
    m = spark.createDataFrame([("b/x", "a"), ("ab", "c"), (None, "b")], "p string, q string").select(dispose.match_subset(["a", "b"], F.col("p"), F.col("q"))).collect()
    assert [r[0] for r in m] == ["a", None, "b"]


def test_length_expansion_counts(spark):
    cols = "raw_id int, question string, options array<string>, gold_answer string, frame_subdir string, video_path string, source_subset string, frames array<string>, image string, image_path string, answer_raw string, cot_raw string, long_cot_raw string"
    base = ("q", ["x", "y"], "<answer>B</answer>", None, None, None)
    rows = [(1, *base, ["f"], None, None, "A", "c", " "), (2, *base, None, None, None, "A", "c", "l"), (3, *base, [None], "i", None, " ", "c", "l"), (4, *base, None, None, "p", "A", None, "l")]
    df = spark.createDataFrame(rows, cols)
    reasons = {r.raw_id: r.skip_reason for r in dispose.length_reason(df).collect()}
    assert reasons == {1: None, 2: "skip_missing_media", 3: "skip_missing_answer", 4: None}
    out = {(r.raw_id, r.reasoning_depth): (r.output, r.gold_answer) for r in expand.length_rows(df).collect()}
    assert set(out) == {(1, "ANSWER"), (1, "COT"), (4, "ANSWER"), (4, "LONG_COT")}
    assert out[1, "COT"] == ("<COT>\nc\n</COT>\n<ANSWER>\nA\n</ANSWER>", "B")


def test_priority_lookup(spark):
    files = spark.createDataFrame([("a.mp4", "m/z/a.mp4"), ("a.mp4", "m/b/a.mp4"), ("c.mp4", "m/c.mp4")], "name string, path string").withColumn("suffix", F.lit(".mp4"))
    rows = spark.createDataFrame([(1, "x/a.mp4", None), (2, "c.mp4", "a.mp4"), (3, "q", ""), (4, None, "m/z/a.mp4")], "id int, v string, w string")
    got = {r.id: (r.path, r.matched_by) for r in resolve.priority_lookup(rows, "id", [("v", F.col("v")), ("w", F.col("w"))], files, ["m"]).collect()}
    assert got == {1: ("m/b/a.mp4", "v"), 2: ("m/c.mp4", "v"), 3: (None, None), 4: ("m/z/a.mp4", "w")}


def test_low_rank_merge(spark):
    cell = "key string, i int, j int, v double"
    w = spark.createDataFrame([("k", 0, 0, 1.0), ("k", 0, 1, 2.0), ("m", 0, 0, 5.0)], cell)
    b, a = spark.createDataFrame([("k", 0, 0, 2.0)], cell), spark.createDataFrame([("k", 0, 0, 3.0), ("k", 0, 1, 4.0)], cell)
    got = {(r.key, r.j): r.v for r in rewards.low_rank_merge(w, a, b, rank=1, alpha=2.0).collect()}
    assert got == {("k", 0): 13.0, ("k", 1): 18.0, ("m", 0): 5.0}
