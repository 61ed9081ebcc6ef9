import pytest
from pyspark.sql import functions as F

from framewright.functions import paths as P
from framewright.functions import rows as R

C = F.col("x")


def one(values, fn, *texts):
    return values([(t,) for t in texts], "x string", fn)


def test_stems_and_keys(values):
    assert one(values, P.safe_stem(C), "é tè/st—1_", "___", None) == ["é_tè_st_1", "sample", "sample"]
    assert one(values, P.frame_key(C), "./a/../b c.mp4", "", None) == ["a__b_c", "sample", "sample"]
    assert one(values, P.repo_path(C), ".././a.mp4", ".hidden", None) == ["a.mp4", "hidden", ""]
    assert one(values, P.suffix(C), "a/B.MP4", "a/.hidden", "a") == [".mp4", "", ""]


def test_relative_path(values):
    rows = [("/d/f/a.jpg", "/d/out"), ("/d/out/a.jpg", "/d/out"), ("/d/out", "/d/out"), ("/x", "/d/e/f")]
    assert values(rows, "x string, s string", P.relative_path(C, F.col("s"))) == ["../f/a.jpg", "a.jpg", ".", "../../../x"]


def test_image_subset_and_suffixes(values):
    rows = [("a/b", "x"), (None, "Spatial/set1/x.png"), ("", "set2/x.png"), (None, None)]
    assert values(rows, "s string, p string", P.image_subset(F.col("s"), F.col("p"))) == ["a", "set1", "set2", "unknown_image"]
    both = (P.has_suffix(C, P.IMAGE_SUFFIXES), P.has_suffix(C, P.STILL_SUFFIXES))
    assert values([("x.bmp",), ("",), (None,), (" A.PNG ",)], "x string", *both) == [(False, True), (False, False), (False, False), (True, True)]


def test_picks(values):
    rows = [("0", " a.mp4 "), ("", "  "), (None, None)]
    got = values(rows, "q string, v string", R.pick_question_id(F.col("q"), F.lit("z")), R.pick_video_id(F.col("v")), R.pick_category(F.col("v")))
    assert got == [("0", "a.mp4", "a.mp4"), ("z", "", "unknown"), ("z", "", "unknown")]


def test_stable_key_and_bucket(values):
    rows = [("v", "7"), ("v", None), (None, "7"), (None, None)]
    got = values(rows, "v string, q string", R.stable_key(F.col("v"), F.col("q")), R.hash_bucket(R.stable_key(F.col("v"), F.col("q"))))
    assert [g[0] for g in got] == ["v::7", "v", "7", "{}"]
    assert got[0][1] == 2004827321


def test_resolve_fields_replaces_both(values):
    rows = [("i", None, None, "p", "c", "s", None), ("i", "x", "o", "p", "c", "s", None), (None, None, None, "p", None, " ", "a"), ("i", None, None, "p", None, None, None)]
    cols = [F.col(c) for c in "ixopcsa"]
    got = values(rows, "i string, x string, o string, p string, c string, s string, a string", R.resolve_fields(*cols))
    assert [tuple(g) if g else None for g in got] == [("p", "c", "s"), ("i", "x", "o"), ("p", "", "a"), None]


def test_rename_and_chat(values):
    assert one(values, R.rename_prefix(C, [("a.b.", "z."), ("b.", "z.")]), "a.b.c", "b.c", "c") == ["z.c", "z.c", "c"]
    turns = R.chat_turns("s", C, F.lit(2))
    got = one(values, R.rebuild_places(turns, F.lit(1), F.lit("f")), "hello")[0]
    assert [p["type"] for p in got["content"]] == ["image", "text"] and got["content"][1]["text"] == "hello"


@pytest.mark.parametrize("attempts,waits", [(1, []), (3, [2.0, 4.0])])
def test_retry_waits(attempts, waits):
    from framewright.sources.files import retry_waits

    assert retry_waits(attempts, 2.0) == waits
