"""Image sizes and memory budgets as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_bounds(w: Column, h: Column, most: int, least: int) -> tuple[Column, Column]:
    """Sides scaled by one factor so that the pixels fall within the bounds; rounded down, 1 at least."""
    pixels = w.cast("bigint") * h
    goal = F.when(pixels > most, F.lit(most)).when(pixels < least, F.lit(least)).otherwise(pixels)
    scale = F.sqrt(goal / pixels.cast("double"))
    side = lambda s: F.when((w <= 0) | (h <= 0) | (goal == pixels), s.cast("bigint")).otherwise(F.greatest(F.lit(1), F.floor(s * scale)).cast("bigint"))
    return side(w), side(h)


def max_side(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    longest = F.greatest(w, h)
    scale = F.lit(float(most)) / longest
    side = lambda s: F.when(longest <= most, s.cast("bigint")).otherwise(F.greatest(F.lit(1), F.floor(s * scale)).cast("bigint"))
    return side(w), side(h)


def min_side(w: Column, h: Column, least: int = 28) -> tuple[Column, Column]:
    shortest = F.least(w, h)
    scale = F.lit(float(least)) / shortest
    side = lambda s: F.when((shortest >= least) | (shortest <= 0), s.cast("bigint")).otherwise(F.greatest(F.lit(least), F.bround(s * scale)).cast("bigint"))
    return side(w), side(h)


def clamp_aspect(w: Column, h: Column, ratio: int = 200) -> tuple[Column, Column, Column, Column]:
    """(width, height, left, top) of a canvas whose short side is padded to long / ratio, the image in its middle."""
    wide = w >= h
    low = F.ceil(F.greatest(w, h) / F.lit(float(ratio))).cast("bigint")
    extreme = (F.greatest(w, h) / F.least(w, h)) > ratio
    new_w = F.when(extreme & ~wide, F.greatest(w, low)).otherwise(w).cast("bigint")
    new_h = F.when(extreme & wide, F.greatest(h, low)).otherwise(h).cast("bigint")
    return new_w, new_h, F.floor((new_w - w) / 2).cast("bigint"), F.floor((new_h - h) / 2).cast("bigint")


def cache_blocks(prompt: Column, completion: Column, generations: Column, batch: int = 1, block: int = 16, max_seqs: int = 32, headroom: int = 128, cap: int = 3072) -> Column:
    """Cache blocks for the longest sequences that run at once, within a cap."""
    need = F.greatest(F.lit(1), F.floor((prompt + completion + (block - 1)) / block))
    seqs = F.least(F.greatest(F.lit(4), generations * max(1, batch)), F.lit(max_seqs))
    return F.least(F.greatest(need * seqs + headroom, need + 32), F.lit(cap)).cast("bigint")


def warn_now(n: Column, first: int = 30, every: int = 200) -> Column:
    """Whether the n-th warning is shown: the first few, then every so many."""
    return (n <= first) | (n % every == 0)
