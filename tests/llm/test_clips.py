from pyspark.sql import functions as F

from framewright.llm import clips as P

C = F.col("x")


def one(values, fn, *texts):
    return values([(t,) for t in texts], "x string", fn)


def test_clip_key_undoes_spellings(values):
    same = ["Set/raw/a b.MP4", "./Set/raw/a%20b.mp4", "../SET//raw/./a b.mp4\t", "Set\\raw\\a b.mp4", "https://h.example/resolve/main/Set/raw/a%20b.mp4?download=1", "/Set/raw/a b.mp4"]
    assert set(one(values, P.clip_key(C), *same)) == {"set/raw/a b.mp4"}
    assert one(values, P.clip_key(C), None, "", " ", "N/A", "unknown", "none", "/", "x.mp4", "100%/a%zz.mp4") == [None, None, None, None, None, None, None, "x.mp4", "100%/a%zz.mp4"]
