"""Encoding of texts with a public byte-level BPE vocabulary.

Texts are cut into pre-tokens; each distinct pre-token of a slice is merged once, in length-bucketed
padded matrices, and the ids of all texts are gathered from the results. No shuffle takes place.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLICE_CHARS = 4_000_000
CACHE_TOKENS = 400_000
LONG = 128
_NONE = np.int32(2**31 - 1)

# The public pre-tokenisation pattern, and the same for texts of ASCII only.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
ASCII_PATTERN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+")


class PairTable:
    """Hash table of (left id, right id) -> merged id with linear probing; the merged id is the rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank or (a is not None and b is not None and len(token) == 2):
                    pairs[a << 20 | b] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        vals = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.vals = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.vals[slot[first]] = keys[first], vals[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, vals, slot = keys[rest], vals[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, or the largest int32 where the pair does not merge. Negative ids never merge."""
        keys = (left.astype(np.int64) << 20 | right).ravel()
        out = np.full(len(keys), _NONE, dtype=np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        for _ in range(self.probes):
            if not len(todo):
                break
            met = self.keys[slot]
            hit = met == keys[todo]
            out[todo[hit]] = self.vals[slot[hit]]
            on = ~hit & (met != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


def load_vocabulary(path: str = VOCABULARY) -> PairTable:
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return PairTable(ranks)


def _merge_matrix(m: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """Merge every row (padded with -1) to the end: per round the leftmost pair of lowest rank in each row."""
    done: list[np.ndarray | None] = [None] * len(m)
    at = np.arange(len(m))
    found = table.find(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else np.full((len(m), 0), _NONE, np.int32)
    while len(m):
        j = found.argmin(axis=1) if found.shape[1] else np.zeros(len(m), np.int64)
        best = found[np.arange(len(m)), j] if found.shape[1] else np.full(len(m), _NONE)
        over = best == _NONE
        if over.any():
            for r in np.flatnonzero(over):
                row = m[r]
                done[at[r]] = row[row >= 0].copy()
            m, at, found, j, best = m[~over], at[~over], found[~over], j[~over], best[~over]
            if not len(m):
                break
        rows, cols = np.arange(len(m)), np.arange(m.shape[1])
        shifted = np.concatenate([m[:, 1:], np.full((len(m), 1), -1, np.int32)], axis=1)
        m = np.where(cols > j[:, None], shifted, m)
        m[rows, j] = best
        fcols = np.arange(found.shape[1])
        fshift = np.concatenate([found[:, 1:], np.full((len(m), 1), _NONE, np.int32)], axis=1)
        found = np.where(fcols >= j[:, None], fshift, found)
        has_left = j > 0
        left = np.where(has_left, m[rows, np.maximum(j - 1, 0)], -1)
        found[rows[has_left], j[has_left] - 1] = table.find(left, m[rows, j])[has_left]
        right = np.where(j + 1 < m.shape[1], m[rows, np.minimum(j + 1, m.shape[1] - 1)], -1)
        inside = j < found.shape[1]
        found[rows[inside], j[inside]] = table.find(m[rows, j], right)[inside]
        width = int((m >= 0).sum(axis=1).max())
        if width < m.shape[1]:
            m, found = m[:, :width], found[:, : max(0, width - 1)]
    return done  # type: ignore[return-value]


def _merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """The same for one long row: all occurrences of the lowest pair, from the left, in one round."""
    while len(ids) > 1:
        found = table.find(ids[:-1], ids[1:])
        low = found.min()
        if low == _NONE:
            break
        hit = found == low
        where = np.flatnonzero(hit)
        run = np.concatenate([[0], np.cumsum(np.diff(where) != 1)])
        start = where[np.concatenate([[True], np.diff(where) != 1])][run]
        where = where[(where - start) % 2 == 0]
        ids = ids.copy()
        ids[where] = low
        keep = np.ones(len(ids), dtype=bool)
        keep[where + 1] = False
        ids = ids[keep]
    return ids


def merge_tokens(tokens: list[bytes], table: PairTable) -> list[np.ndarray]:
    """Ids of every byte string, in buckets of length 1-2, 3-4, 5-8, ... ."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(tokens)
    sizes = np.array([len(t) for t in tokens])
    for r in np.flatnonzero(sizes > LONG):
        out[r] = _merge_long(table.byte_ids[np.frombuffer(tokens[r], np.uint8)], table)
    low, high = 0, 2
    while low < LONG:
        rows = np.flatnonzero((sizes > low) & (sizes <= high))
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            flat = table.byte_ids[np.frombuffer(b"".join([tokens[r] for r in part]), np.uint8)]
            width = int(sizes[part].max()) if len(part) else 0
            m = np.full((len(part), width), -1, dtype=np.int32)
            m[np.arange(width) < sizes[part][:, None]] = flat
            for r, ids in zip(part, _merge_matrix(m, table), strict=True):
                out[r] = ids
        low, high = high, high * 2
    return out


class Encoder:
    """Encodes lists of texts; keeps the ids of pre-tokens met before, up to CACHE_TOKENS of them."""

    def __init__(self, table: PairTable) -> None:
        self.table = table
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start, self.size, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        ids = merge_tokens([t.encode("utf-8", "surrogatepass") for t in new], self.table)
        lengths = np.array([len(i) for i in ids], dtype=np.int64)
        need, first = self.used + int(lengths.sum()), len(self.number)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * need - self.used, np.int32)])
        self.flat[self.used : need] = np.concatenate(ids) if ids else []
        if first + len(new) > len(self.start):
            grow = 2 * (first + len(new))
            self.start, self.size = (np.concatenate([a[:first], np.zeros(grow - first, np.int64)]) for a in (self.start, self.size))
        self.start[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.size[first : first + len(new)] = lengths
        self.used = need
        self.number.update(zip(new, range(first, first + len(new)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids of each text); null and empty texts have none."""
        if len(self.number) > CACHE_TOKENS:
            self._reset()
        cut = [(ASCII_PATTERN if t.isascii() else PATTERN).findall(t) if t else [] for t in texts]
        tokens = [x for c in cut for x in c]
        number = self.number
        new = list(dict.fromkeys([x for x in set(tokens) if x not in number]))
        if new:
            self._learn(new)
        at = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)]
        per_text = np.array([len(c) for c in cut], dtype=np.int64)
        edge = np.concatenate([[0], np.cumsum(per_text)])
        upto = np.concatenate([[0], ends])
        return ids, upto[edge[1:]] - upto[edge[:-1]]


def encode_column(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row: ids without special tokens, whose spellings in a text are ordinary text.

    Null and empty texts give an empty list. The vocabulary's pair table, of fixed size, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = dict(df.dtypes)[id_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < SLICE_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                ids, sizes = encoder.encode(texts[at:end])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists], ["id", "ids"])
                at = end

    return df.select(id_col, text_col).mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
