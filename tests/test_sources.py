import json

import pytest
from pyspark.sql import functions as F

from framewright.operators.sampling import hash_split
from framewright.sources import files, jsonl, media, sinks
from framewright.streaming import split_stream


def test_records_array_lines_and_empty(spark, tmp_path):
    rows = [{"a": 1, "b": "é"}, {"a": 2, "b": None}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    (tmp_path / "x.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    (tmp_path / "e.jsonl").write_text("")
    for name in ("x.json", "x.jsonl"):
        got = jsonl.read_by_suffix(spark, str(tmp_path / name), "a int, b string")
        assert sorted((r.a, r.b) for r in got.collect()) == [(1, "é"), (2, None)]
    assert jsonl.read_records(spark, str(tmp_path / "e.jsonl"), "a int").count() == 0
    with pytest.raises(ValueError):
        jsonl.read_by_suffix(spark, str(tmp_path / "x.csv"))


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_many_files_keep_their_origin(spark, tmp_path):
    for k in "ab":
        (tmp_path / f"{k}.jsonl").write_text(json.dumps({k: 1, "z": k}) + "\n")
    got = jsonl.read_many(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).collect()
    assert {(r.z, r.source_path.rsplit("/", 1)[1]) for r in got} == {("a", "a.jsonl"), ("b", "b.jsonl")}
    assert {r.source_dir.rsplit("/", 1)[1] for r in got} == {tmp_path.name}


def test_tolerant_lines(spark):
    lines = ["", "bad{", "[1]", '{"a":2}]', '{"a": 1}', '{"a":1} x', '"s"']
    got = [r.status for r in jsonl.tolerant_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    assert got == ["blank", "unparsable", "not_object", "unparsable", "ok", "unparsable", "not_object"]


def test_canonical_and_configs(spark):
    a = spark.createDataFrame([("v", 7)], "video_id string, question_id int")
    df = jsonl.to_canonical(jsonl.read_configs({"x": a, "y": a.select("video_id")}))
    assert df.columns == [f.name for f in jsonl.CANONICAL.fields] and {r.question_id for r in df.collect()} == {"7", None}


def test_catalogue(spark, tmp_path):
    for p in ("a/1.jpg", "a/2.JPG", "b/3.txt", "b/c/4.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    found = files.list_files(spark, str(tmp_path), files.FRAME_SUFFIXES)
    assert sorted(r.name for r in found.collect()) == ["1.jpg", "2.JPG", "4.png"]
    assert sorted(len(r.frames) for r in files.frame_lists(found).collect()) == [1, 2]


def test_layout():
    have = {"r/train_80.jsonl", "r/test_20.jsonl"}
    assert files.pick_layout(have.__contains__, "r") == {"train": "r/train_80.jsonl", "test": "r/test_20.jsonl"}
    with pytest.raises(FileNotFoundError):
        files.pick_layout(lambda p: False, "r")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "eval"), (2, None, "train")], "a int, b string, split string")
    sinks.write_jsonl(df, str(tmp_path / "o"), single_file=True)
    lines = [json.loads(x) for p in (tmp_path / "o").glob("part-*") for x in p.read_text().splitlines()]
    assert {x["b"] for x in lines} == {"é", None}
    sinks.write_splits(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=eval").exists()
    assert sinks.write_summary(df.agg(F.count("*").alias("n")), str(tmp_path / "q" / "s.json")) == {"n": 2}
    with pytest.raises(ValueError):
        sinks.require_rows(df.filter("a > 5"), "the split")


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"video_id": f"v{i}.mp4" if i % 5 else f"v{i}.png", "question_id": str(i)} for i in range(200)] + [{"x": 1}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(json.dumps(r) for r in rows) + "\nbad{\n\n")
    q = split_stream.stream_split(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), 0.2)
    q.awaitTermination(60)
    got = {(r.value, r.split) for r in spark.read.json(str(tmp_path / "out")).collect()}
    batch = split_stream.split_lines(spark.read.text(str(tmp_path / "in")), 0.2)
    assert got == {(r.value, r.split) for r in batch.collect()} and len(got) == 161
    key = F.concat_ws("::", F.get_json_object("value", "$.video_id"), F.get_json_object("value", "$.question_id"))
    plain = hash_split(batch.select("value").filter("value LIKE '%video_id%'"), key, 0.2)
    assert {(r.value, r.split) for r in plain.collect()} <= got


def test_media_seams(spark):
    clips = spark.createDataFrame([("a.mp4", [0, 5]), ("bad", [1])], "path string, indices array<int>")

    def decoder(path, indices):
        if path == "bad":
            raise OSError("no such clip")
        return [f"{path}:{i}" for i in indices]

    got = {r.path: (r.frames, r.status) for r in media.decode_frames(clips, decoder).collect()}
    assert got["a.mp4"] == (["a.mp4:0", "a.mp4:5"], "ok") and got["bad"][0] == [] and "no such clip" in got["bad"][1]
    scored = media.score_with(clips.select("path", F.lit("c").alias("c")), "path", "c", lambda p, c: p.str.len())
    assert {r.path: r.reward_model for r in scored.collect()} == {"a.mp4": 5.0, "bad": 3.0}
