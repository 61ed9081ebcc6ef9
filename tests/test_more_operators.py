import json

import pytest
from pyspark.sql import functions as F

from framewright.functions import paths as P
from framewright.functions import rows as R
from framewright.operators import resolve, rewards, scoring
from framewright.sources import config, jsonl, sinks

C = F.col


def test_joined_path(values):
    rows = [("../a/./b.jpg", "data/x"), ("/abs//b", "data"), ("../../../up", "data"), ("b", "/r/s"), ("..", "/r"), (None, "d")]
    assert values(rows, "x string, s string", P.joined_path(C("x"), C("s"))) == ["data/a/b.jpg", "/abs/b", "../../up", "/r/s/b", "/", None]


def test_keys(values):
    one = lambda fn, *t: values([(x,) for x in t], "x string", fn)
    assert one(R.adapter_key(C("x")), "b.model.model.visual.merger.0.lora_A.weight", "a.lora_A.weight", None) == ["b.model.visual.merger.0.lora_A.default.weight", "a.lora_A.weight", None]
    assert one(R.strip_wrapper(C("x")), "base_model.a", "a.base_model.b") == ["a", "a.base_model.b"]
    assert one(R.is_quantiser_key(C("x")), "a.SCB", "a.SCB.b", "a.weight", "a.weight_format") == [True, True, False, True]


def test_media_cascades(spark):
    files = spark.createDataFrame([(p,) for p in ["in/a.jpg", "fr/train/s/2.png", "fr/train/s/1.JPG", "fr/train/s/x.webp", "fr/val/clip_1/0.jpeg", "fr/bare/x.txt", "in/one.png", "fr/own/9.jpg"]], "path string")
    rows = spark.createDataFrame(
        [
            (1, ["a.jpg", "gone.jpg", None, " "], None, "train", "s", "c", None), (2, ["gone.jpg"], None, "train", "s", "c", "one.png"), (3, None, None, "val", None, "d/clip 1.mp4", "one.png"), (4, [], "fr/bare", "val", "s", "clip_1", None),
            (5, None, "own", "x", None, None, None), (6, None, None, None, None, None, None),
        ],
        "id int, frames array<string>, dir string, split string, sub string, video string, image string",
    ).withColumn("item", F.lit("clash"))
    got = {r.id: r.frames for r in resolve.frame_cascade(rows, "id", files, lists=[C("frames")], frame_dir=C("dir"), split=C("split"), subdir=C("sub"), video_id=C("video"), root="fr", base="in").collect()}
    assert got == {1: ["in/a.jpg"], 2: ["fr/train/s/1.JPG", "fr/train/s/2.png"], 3: ["fr/val/clip_1/0.jpeg"], 4: [], 5: ["fr/own/9.jpg"], 6: []}
    sft = {r.id: (r.frames, r.image) for r in resolve.sft_media_cascade(rows, "id", files, frames=C("frames"), subdir=C("sub"), singles=[C("image")], root="fr", base="in", out_dir="out", most=1).collect()}
    assert sft == {1: (["../in/a.jpg"], None), 2: (["../fr/train/s/1.JPG"], None), 3: (None, "../in/one.png"), 4: (["../fr/train/s/1.JPG"], None), 5: (None, None), 6: (None, None)}
    assert resolve.frame_cascade(rows.filter("id < 0"), "id", files, lists=[C("frames")], frame_dir=C("dir"), split=C("split"), subdir=C("sub"), video_id=C("video"), root="fr", base="in").count() == 0


def test_summary_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("<ANSWER>A</ANSWER>", "A", "v"), ("B", "A", "v"), (None, None, None)], "completion string, solution string, video_id string")
    scored = scoring.score_completions(df, "completion", "solution", tokens=lambda c: F.length(c))
    r = scoring.eval_summary(scored).collect()[0]
    assert r.n == 3 and r.answer_accuracy == pytest.approx(0.666667, abs=1e-5) and r.avg_completion_tokens == pytest.approx(19 / 3, abs=1e-5)
    assert r.pred_answer_counts == {"a": 1, "b": 1, "": 1} and r.reasoning_kind_counts == {"none": 3}
    empty = scoring.eval_summary(scored.filter("completion = 'x'")).collect()[0]
    assert empty.n == 0 and empty.answer_accuracy == 0.0
    wide = scored.withColumns({c: F.lit("q") for c in ("question_id", "question_category", "problem", "pred_raw", "problem_cleaned")})
    assert len(sinks.prediction_columns(wide.drop("problem_cleaned")).columns) == 17 and len(sinks.prediction_columns(wide).columns) == 18
    assert sinks.prediction_columns(wide.drop("problem_cleaned"), training=True).columns == ["video_id", "question_id", "question_category", "problem", "pred_raw", "pred_answer", "gt_answer", "correct", "format_ok"]
    sinks.write_report(scoring.eval_report(scored), sinks.prediction_columns(wide), str(tmp_path / "r"))
    assert json.loads((tmp_path / "r" / "metrics.json").read_text())["n"] == 3 and spark.read.json(str(tmp_path / "r" / "results")).count() == 3
    kept = spark.createDataFrame([({"a": "1", "b": "2"},)], "m map<string,string>").select(sinks.allowed_keys("m", ["b"]).alias("m")).collect()[0].m
    assert kept == {"b": "2"}


def test_reward_summary_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (1, None, 0.0), (2, 1.0, 1.0)], "g int, a double, reward double")
    r = rewards.reward_summary(df, ["g"], ["a"]).collect()[0]
    assert (r.mean_a, r.mean_reward) == (0.75, pytest.approx(2 / 3)) and r.reward_std == pytest.approx(0.5**0.5)
    assert rewards.reward_summary(df.filter("g > 9"), ["g"], ["a"]).count() == 0


def test_many_files_and_prefix(spark, tmp_path):
    (tmp_path / "b a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "a.json").write_text('\n [{"x": 3, "y": "k"},\n {"x": 4}]')
    got = sorted((r.x, r.y, r.source_path.rsplit("/", 1)[1]) for r in jsonl.read_many(spark, [str(tmp_path / "b a.jsonl"), str(tmp_path / "a.json")]).collect())
    assert got == [(1, None, "b%20a.jsonl"), (2, None, "b%20a.jsonl"), (3, "k", "a.json"), (4, None, "a.json")]
    for i in range(3):
        (tmp_path / f"p{i}.jsonl").write_text("".join(json.dumps({"x": i * 10 + k}) + "\n" for k in range(10)))
    first = jsonl.read_prefix(spark, [str(tmp_path / f"p{i}.jsonl") for i in (2, 0, 1)], 12, "x int")
    assert sorted(r.x for r in first.collect()) == list(range(12))


def test_config():
    c = config.parse_config('{"output_dir": "o", "sft_mode": " LENGTH "}')
    assert c.merge_output_dir == "o_merged" and c.sft_mode == "length"
    for bad in ("[1]", '{"nope": 1}', '{"sft_mode": "x"}'):
        with pytest.raises(ValueError):
            config.parse_config(bad)
