from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.functions import arrays as A
from framewright.functions import geometry as G

X = F.col("x")


def test_strided(values):
    rows = [(list(range(20)),), ([1, 2],), ([],)]
    assert values(rows, "x array<int>", A.strided(X, 8)) == [[0, 2, 4, 6, 8, 10, 12, 14], [1, 2], []]
    assert values(rows[:1], "x array<int>", A.strided(X, 0)) == [list(range(20))]


def test_uniform_indices(values):
    rows = [(5,), (1,), (0,), (100,)]
    got = values(rows, "x int", A.pad_last(A.uniform_indices(X, 8), 8, F.lit(-1).cast("bigint")))
    assert got[0] == [0, 1, 2, 3, 4, 4, 4, 4]
    assert got[1] == [0] * 8 and got[2] == [-1] * 8 and got[3][0] == 0 and got[3][-1] == 99
    assert values(rows, "x int", A.uniform_indices(X, 1)) == [[0], [0], [], [0]]


def test_masks(values):
    rows = [([5, 6, 2, 7, 8],), ([5, 6],), ([],)]
    assert values(rows, "x array<int>", A.eos_mask(X, F.lit(2))) == [[1, 1, 1, 0, 0], [1, 1], []]
    assert values(rows[:1], "x array<int>", A.pad_left(X, 7, F.lit(0))) == [[0, 0, 5, 6, 2, 7, 8]]
    assert values(rows[:1], "x array<int>", A.pad_left(X, 2, F.lit(0))) == [[7, 8]]
    assert values(rows[:1], "x array<int>", A.label_mask(X, F.lit(2), F.lit(8))) == [[-100, -100, 2, 7, -100]]


def test_masked_mean_of_nothing_is_null(values):
    rows = [([1.0, 2.0], [0, 0]), ([1.0, 3.0], [1, 1]), ([], [])]
    assert values(rows, "x array<double>, m array<int>", A.masked_mean(X, F.col("m"))) == [None, 2.0, None]


def test_geometry(values):
    rows = [(10, 4000), (100, 100), (4000, 10), (14, 56)]
    assert [t[:2] for t in values(rows, "w int, h int", *G.clamp_aspect(F.col("w"), F.col("h")))] == [(20, 4000), (100, 100), (4000, 20), (14, 56)]
    assert values(rows[3:], "w int, h int", *G.min_side(F.col("w"), F.col("h"))) == [(28, 112)]
    assert values([(1000, 1000)], "w int, h int", *G.pixel_bounds(F.col("w"), F.col("h"), 501760, 3136)) == [(708, 708)]
    assert values([(1536, 20)], "w int, h int", *G.max_side(F.col("w"), F.col("h"), 768)) == [(768, 10)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 12))
def test_strided_never_exceeds(spark, xs, most):
    got = spark.createDataFrame([(xs,)], "x array<int>").select(A.strided(X, most)).first()[0]
    assert len(got) <= max(most, 0) if len(xs) > most else got == xs
