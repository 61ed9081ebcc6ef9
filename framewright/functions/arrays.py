"""Column builders over arrays: sampling of frames, masks, padding, masked means, token kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strided(xs: Column, most: int) -> Column:
    """Every n//most-th element, at most ``most``; all of them where there are no more, or ``most`` <= 0."""
    if most <= 0:
        return xs
    step = F.greatest(F.lit(1), F.floor(F.size(xs) / most)).cast("int")
    return F.when(F.size(xs) <= most, xs).otherwise(F.slice(F.filter(xs, lambda x, i: i % step == 0), 1, most))


def head(xs: Column, most: int) -> Column:
    return F.slice(xs, 1, most)


def uniform_indices(total: Column, n: int) -> Column:
    """``n`` evenly spaced frame numbers of ``total``: whole parts of a linear space, doubles dropped. Empty for no frames."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    spaced = F.transform(at, lambda i: F.floor((i * (total - 1)) / (n - 1))) if n > 1 else F.array(F.lit(0).cast("bigint"))
    return F.when(total > 0, F.array_distinct(spaced)).otherwise(F.array().cast("array<bigint>"))


def pad_last(xs: Column, n: int, blank: Column) -> Column:
    """Padded to ``n`` with the last element, or with ``blank`` where there is none."""
    last = F.coalesce(F.try_element_at(xs, F.lit(-1)), blank)
    return F.concat(xs, F.array_repeat(last, F.greatest(F.lit(n) - F.size(xs), F.lit(0))))


def eos_mask(tokens: Column, eos: Column) -> Column:
    """1 up to and with the first end token, 0 after it; all 1 without one."""
    first = F.array_position(tokens, eos)
    return F.transform(tokens, lambda t, i: F.when((first == 0) | (i < first), 1).otherwise(0))


def keep_last(tokens: Column, n: int) -> Column:
    return F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), n)


def pad_left(tokens: Column, n: int, pad: Column) -> Column:
    kept = keep_last(tokens, n)
    return F.concat(F.array_repeat(pad, n - F.size(kept)), kept)


def pad_right(tokens: Column, n: int, pad: Column) -> Column:
    kept = F.slice(tokens, 1, n)
    return F.concat(kept, F.array_repeat(pad, n - F.size(kept)))


def label_mask(tokens: Column, prompt_length: Column, pad: Column, ignore: int = -100) -> Column:
    """Tokens as labels, with prompt and padding positions set to ``ignore``."""
    return F.transform(tokens, lambda t, i: F.when((i < prompt_length) | (t == pad), F.lit(ignore)).otherwise(t))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def masked_mean(xs: Column, mask: Column) -> Column:
    """Mean of the elements with mask 1; NULL where the mask is empty or all 0."""
    return F.try_divide(total(F.zip_with(xs, mask, lambda x, m: x.cast("double") * m)), total(F.transform(mask, lambda m: m.cast("double"))))


def k3_divergence(logp: Column, ref: Column) -> Column:
    """exp(r - p) - (r - p) - 1 per token."""
    return F.zip_with(ref, logp, lambda r, p: F.exp(r - p) - (r - p) - 1)


def token_loss(divergence: Column, advantage: Column, beta: float) -> Column:
    return F.transform(divergence, lambda k: -(advantage - F.lit(beta) * k))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """Log probability of one position, shifted by the maximum."""
    top = F.array_max(logits)
    return F.get(logits, index) - (top + F.log(total(F.transform(logits, lambda v: F.exp(v - top)))))


def weighted_sum(rewards: Column, weights: Column) -> Column:
    return total(F.zip_with(rewards, weights, lambda r, w: r * w))
