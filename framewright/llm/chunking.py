"""Content-defined chunks of short texts, computed for a whole batch at once."""

from __future__ import annotations

import numpy as np

WINDOW = 4
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x100000001B3 | 1, k, 1 << 64) for k in range(1 << 12)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_texts(texts: list[bytes], mask_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut every text after each byte whose rolling hash over WINDOW bytes has ``mask_bits`` zero bits.

    Returns (text number, digest, length) per chunk, in order. A text without a cut is one chunk; an empty
    text has none. Cuts depend on WINDOW bytes only, so an edit disturbs the chunks next to it and no others.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    roll = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        roll[k:] = roll[k:] * _P + (buf[: n - k] + np.uint64(1)) if k == 0 else roll[k:] + mix64(buf[: n - k] + np.uint64(257 * k))
    is_cut = (mix64(roll) & np.uint64((1 << mask_bits) - 1)) == 0
    ends = np.cumsum(sizes)
    starts_text = ends - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    pos = np.arange(n) - starts_text[owner]
    is_cut &= pos >= WINDOW - 1
    is_cut[ends[sizes > 0] - 1] = True
    return digests(buf, owner, is_cut)


def digests(buf: np.ndarray, owner: np.ndarray, is_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, digest, length) of the pieces that end at the marked bytes."""
    n = len(buf)
    cut_at = np.flatnonzero(is_cut)
    starts = np.concatenate([[0], cut_at[:-1] + 1])
    length = cut_at - starts + 1
    number = np.repeat(np.arange(len(starts)), length)
    offset = (np.arange(n) - starts[number]) & 0xFFF
    digest = np.add.reduceat((buf + np.uint64(1)) * _POWERS[offset], starts)
    return owner[starts], mix64(digest + length.astype(np.uint64) * _P), length


def word_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, digest, length with the blank after it) of the blank-separated words."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8).astype(np.uint64)
    return digests(buf, np.repeat(np.arange(len(texts)), sizes), buf == 32)


def word_bits(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text, a 64-bit map of its blank-separated words and their number."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, digest, _ = word_digests(texts)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return np.bitwise_or.reduceat(np.uint64(1) << (digest >> np.uint64(58)), first).view(np.int64), np.bincount(owner, minlength=len(texts))
