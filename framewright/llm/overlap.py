"""Same or near-same records across splits, found by content-defined chunks.

A record is the question asked about a clip. Its normalised text is cut by a rolling hash; chunk digests are
joined across splits, and the lengths of the chunks that two records share add up to the overlap: the share of
the one with fewer bytes that lies in the other. Pairs of at least the overlap asked for go on to an exact check
of the wording, as another question with the same options may overlap as much as a copy.

The join uses a prefix filter: the rarest chunks of a record, so many that the rest are too short to reach
the overlap, meet all chunks of the other record, as a lead-in may be rarer than the question after it.
Any fixed order of the chunks makes this exact; a table of 2**16 counters over all records gives an order
that keeps common phrases out of the join, and tells hot chunks, whose rows are spread over SALTS keys.
A lead-in also changes the first and the last chunk of a question; where the chunks between them are too
short, its words count as chunks as well.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.chunking import chunk_texts, mix64, word_bits, word_digests
from framewright.llm.clips import clip_key
from framewright.session import cut

COUNTER_BITS = 16
MASK_BITS = 3
MARK_BITS = 20
#: Keys a hot chunk of one clip is spread over, and the share of all chunks that makes it hot; cells in which such chunks are counted.
SALTS, HOT_SHARE, HEAT_BITS = 8, 1 / 512, 18
_CLIP, _WORDS_APART, _LONGER, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)

_OPTIONS = re.compile(r"(?is)(?:^|\s)(?:answer\s+)?(?:options?|choices?)\s*[:：].*$|\n\s*\(?A\)?\s*[.):]?\s.*$")
_LABEL = re.compile(r"^\W*(?:question|q)\s*[.:：)\-]+\s*")
_TAG = re.compile(r"</?[a-z][^<>]{0,40}>")
_WORD = re.compile(r"\w+")


def asked(problem: str) -> str:
    """The question of ``problem`` in a plain spelling: no label, options, case, punctuation or markup."""
    t = unicodedata.normalize("NFKC", html.unescape(problem))
    t = "".join(c for c in t if unicodedata.category(c) != "Cf") if not t.isascii() else t
    head = _OPTIONS.sub("", t)
    t = (head if _WORD.search(head) else t).lower()
    t = _LABEL.sub("", _TAG.sub(" ", t))
    return " ".join(_WORD.findall(t))


def slip(a: str, b: str) -> bool:
    """Whether two different words differ by one slip: a letter added, lost, swapped or changed (two in long words),
    a small word exchanged for its like (the, that), or two digits swapped."""
    if any(c.isdigit() for c in a + b):
        return a.isdigit() and b.isdigit() and len(a) == len(b) and sorted(a) == sorted(b)
    if abs(len(a) - len(b)) > 2:
        return False
    most = 2 if min(len(a), len(b)) >= 8 or (max(len(a), len(b)) <= 4 and a[:1] == b[:1]) else 1
    d = [[max(i, j) if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1] <= most


def slips_allowed(n_words: int) -> int:
    return max(2, n_words // 6)


def same_question(a: str, b: str, lead_in: int = 8) -> bool:
    """Whether two plain questions differ only in slips, spacing and a lead-in or closing of a few words."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) > len(y):
        x, y = y, x
    changed = 0
    for op, i, k, j, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        left, right = x[i:k], y[j:m]
        if not left and (j == 0 or m == len(y)):
            if m - j > lead_in or any(any(c.isdigit() for c in w) for w in right):
                return False
            continue
        if len(left) == len(right):
            if not all(slip(p, q) for p, q in zip(left, right, strict=True)):
                return False
            changed += len(left)
        elif i == 0 and len(right) > len(left) and all(p == q or slip(p, q) for p, q in zip(left, right[-len(left) :], strict=True)):
            changed += len(left)
        elif "".join(left) == "".join(right) or (left and right and slip("".join(left), "".join(right))):
            changed += 1
        else:
            return False
    return changed <= slips_allowed(len(x)) and len(x) >= 3


def question_rows(rows: DataFrame, id_col: str, video: str, problem: str, split: str, train: tuple[str, ...]) -> DataFrame:
    """(id, clip, in_train, text) of rows that name a clip and ask something; the clip as a 64-bit hash of its key."""
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), clip_key(F.col(video)).alias("clip"), F.col(split).isin(*train).alias("in_train"), F.col(problem).alias("text"))
    base = base.filter("clip IS NOT NULL AND text IS NOT NULL AND in_train IS NOT NULL").withColumn("clip", F.xxhash64("clip"))

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [asked(t) for t in b["text"]]
            yield b[b["text"] != ""]

    return base.mapInPandas(plain, "id bigint, clip bigint, in_train boolean, text string")


def _chunks(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, digest, length) of the chunks of all texts."""
    return chunk_texts([t.encode() for t in texts], MASK_BITS)


def thin_texts(owner: np.ndarray, length: np.ndarray, n: int, overlap: float) -> np.ndarray:
    """Whether the chunks between the first and the last fall short of ``overlap`` of a text."""
    whole = np.bincount(owner, weights=length, minlength=n)
    edge = np.concatenate([[True], owner[1:] != owner[:-1]]) | np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
    return np.bincount(owner[~edge], weights=length[~edge], minlength=n) < overlap * whole


def word_keys(b: pd.DataFrame, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, joins) of all words; the longest words of a thin text join, one more than slips may change."""
    owner, digest, length = word_digests([t.encode() for t in b["text"]])
    order = np.lexsort((digest, -length, owner))
    owner, digest = owner[order], digest[order]
    n = np.bincount(owner, minlength=len(b))
    rank = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    joins = thin[owner] & (n[owner] >= 3) & (rank <= np.maximum(2, n[owner] // 6))
    return owner, mix64(digest ^ b["clip"].to_numpy().view(np.uint64)[owner] * _CLIP ^ _WORDS_APART), joins


def _mark(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _clip_keys(b: pd.DataFrame, owner: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return digest ^ b["clip"].to_numpy().view(np.uint64)[owner] * _CLIP


def _heat_cell(key: np.ndarray) -> np.ndarray:
    return (mix64(key) >> np.uint64(64 - HEAT_BITS)).astype(np.int64)


def chunk_counters(texts: DataFrame, overlap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk counts of all texts in 2**COUNTER_BITS cells, counts of the words that join in 2**MARK_BITS, of a clip's chunks in 2**HEAT_BITS: tables of fixed size."""
    parts = np.cumsum([0, 1 << COUNTER_BITS, 1 << MARK_BITS, 1 << HEAT_BITS])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(parts[-1], dtype=np.int64)
        cells, marks, heat = (total[a:z] for a, z in zip(parts, parts[1:], strict=False))
        for b in batches:
            owner, digest, length = _chunks(b["text"])
            cells += np.bincount((digest >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(cells))
            heat += np.bincount(_heat_cell(_clip_keys(b, owner, digest)), minlength=len(heat))
            thin = thin_texts(owner, length, len(b), overlap)
            if thin.any():
                some = b[thin]
                _, key, joins = word_keys(some, np.ones(len(some), bool))
                marks += np.bincount(_mark(key[joins]), minlength=len(marks))
        # what is under half of the share in every task is under it in all; the other half allows for what is left out
        heat[heat < HOT_SHARE * heat.sum() / 2] = 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    got = texts.select("clip", "text").mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(parts[-1], dtype=np.int64)
    out[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    cells, marks, heat = (out[a:z] for a, z in zip(parts, parts[1:], strict=False))
    return cells, marks, heat > HOT_SHARE * cells.sum() / 2


def _keys(b: pd.DataFrame, counters: np.ndarray, marks: np.ndarray, heat: np.ndarray, overlap: float, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, own) of all keys under which the texts of a batch join."""
    owner, digest, length = _chunks(b["text"])
    cell = (digest >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
    order = np.lexsort((digest, counters[cell], owner))
    o, ln = owner[order], length[order]
    whole = np.bincount(owner, weights=length, minlength=len(b))
    run = np.cumsum(ln) - ln
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    before = run - np.repeat(run[first], np.diff(np.append(first, len(o))))
    own = whole[o] - before >= overlap * whole[o]
    k = _clip_keys(b, o, digest[order])
    hot = heat[_heat_cell(k)]
    if len(b) and marks.any():
        at, key, joins = word_keys(b, thin_texts(owner, length, len(b), overlap))
        met = marks[_mark(key)]
        hit = met > 0
        o, k, own, hot = np.concatenate([o, at[hit]]), np.concatenate([k, key[hit]]), np.concatenate([own, joins[hit]]), np.concatenate([hot, met[hit] > max(64.0, HOT_SHARE * counters.sum())])
    if left:
        spread = hot & own
        k = np.where(own, k, k ^ _LONGER)
    else:
        spread = np.concatenate([np.zeros(len(o), bool), (hot & own)[own]])
        o, k, hot, own = np.concatenate([o, o[own]]), np.concatenate([k, k[own] ^ _LONGER]), np.concatenate([hot, hot[own]]), np.concatenate([own, own[own]])
    # rows of a hot chunk go to one of SALTS keys, and the few own ones that they meet to all of them
    salt = np.where(hot & ~spread, mix64(b["t"].to_numpy().view(np.uint64)[o]) % np.uint64(SALTS), np.uint64(0))
    times = np.where(spread, SALTS, 1)
    o, k, own, salt = np.repeat(o, times), np.repeat(k, times), np.repeat(own, times), np.repeat(salt, times)
    copy = np.arange(len(o)) - np.repeat(np.cumsum(times) - times, times)
    salt = np.where(np.repeat(spread, times), copy.astype(np.uint64), salt)
    return o, k ^ salt * _SALT, own


def chunk_keys(texts: DataFrame, counters: np.ndarray, marks: np.ndarray, heat: np.ndarray, overlap: float, left: bool) -> DataFrame:
    """(k, t, own, bits, words): keys of each text. ``own`` are its rarest chunks, until the rest fall short of
    ``overlap`` of its length, and the words by which a thin text joins; other keys only meet own ones.

    ``k`` joins equal chunks on one clip; ``bits`` and ``words`` describe the text's words. Other keys of the
    left side carry a mark in ``k``, and own keys of the right side come with and without it, so that two other keys never meet.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            o, k, own = _keys(b, counters, marks, heat, overlap, left)
            bits, words = word_bits([t.encode() for t in b["text"]])
            yield pd.DataFrame({"k": k.view(np.int64), "t": b["t"].to_numpy()[o], "own": own, "bits": bits[o], "words": words[o].astype(np.int16)})

    return texts.mapInPandas(pick, "k bigint, t bigint, own boolean, bits bigint, words smallint")


def shared_shares(a: list[str], b: list[str], overlap: float) -> np.ndarray:
    """Overlap of each pair of texts: the length of the chunks both hold, as a share of the text with fewer bytes.

    Where the chunks between the first and the last of either text fall short of ``overlap``, words are chunks.
    """
    n = len(a)
    if not n:
        return np.zeros(0)
    data = [t.encode() for t in [*a, *b]]
    owner, digest, length = chunk_texts(data, MASK_BITS)
    thin = thin_texts(owner, length, 2 * n, overlap)
    thin = thin[:n] | thin[n:]
    out = _contained(owner, digest, length, n)
    some = np.flatnonzero(thin)
    if len(some):
        by_word = word_digests([data[k] for k in [*some.tolist(), *(some + n).tolist()]])
        out[some] = np.maximum(out[some], _contained(*by_word, len(some)))
    return out


def _contained(owner: np.ndarray, digest: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Shared length over the smaller total of texts k and n + k; a chunk counts as often as both hold it."""
    total = np.bincount(owner, weights=length, minlength=2 * n)
    pair, side = owner % n, owner >= n
    order = np.lexsort((side, digest, pair))
    p, d, s, ln = pair[order], digest[order], side[order], length[order]
    edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]))
    left = np.add.reduceat(~s, edge, dtype=np.int64)
    right = np.add.reduceat(s, edge, dtype=np.int64)
    shared = np.bincount(p[edge], weights=ln[edge] * np.minimum(left, right), minlength=n)
    return shared / np.maximum(1.0, np.minimum(total[:n], total[n:]))


def question_links(rows: DataFrame, id_col: str = "row_id", video: str = "video_id", problem: str = "problem", split: str = "split_name", train: tuple[str, ...] = ("train",), overlap: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """Links (ta, tb, overlap) between classes of equal wording, and membership (id, in_train, t) of the rows.

    A class is a question in its plain spelling on one clip. A class with rows in both splits is linked to
    itself with an overlap of 1. Links are between a class with training rows and one with evaluation rows.
    """
    asks = question_rows(rows, id_col, video, problem, split, train).withColumn("t", F.xxhash64("clip", "text"))
    # texts are spelt out twice, as keeping them for every row takes more disk than any shuffle here
    members = cut(asks.select("id", "in_train", "t"))
    # read several times below, and shuffled once
    texts = cut(asks.groupBy("t", "clip", "text").agg(F.max("in_train").alias("in_train"), F.max(~F.col("in_train")).alias("in_eval")))
    counters, marks, heat = chunk_counters(texts, overlap)
    left, right = texts.filter("in_train").select("t", "clip", "text"), texts.filter("in_eval").select("t", "clip", "text")
    a = chunk_keys(left, counters, marks, heat, overlap, True)
    b = chunk_keys(right, counters, marks, heat, overlap, False)
    near = a.join(b.withColumnsRenamed({"t": "tb", "own": "own_b", "bits": "bits_b", "words": "words_b"}), "k").filter("t <> tb")
    fewer = F.col("words") <= F.col("words_b")
    near = near.filter((F.col("own") & F.col("own_b")) | F.when(fewer, F.col("own")).otherwise(F.col("own_b")))
    lost = F.bit_count(F.when(fewer, F.col("bits")).otherwise(F.col("bits_b")).bitwiseAND(F.bitwise_not(F.when(fewer, F.col("bits_b")).otherwise(F.col("bits")))))
    near = near.filter(lost <= F.greatest(F.lit(2), F.floor(F.least("words", "words_b") / 6)) + 1)
    near = near.select(F.col("t").alias("ta"), "tb").distinct()
    wording = texts.select(F.col("t").alias("ta"), F.col("clip").alias("ca"), F.col("text").alias("a"))
    near = near.join(wording, "ta").join(wording.toDF("tb", "cb", "b"), "tb").filter("ca = cb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            share = shared_shares(x["a"].tolist(), x["b"].tolist(), overlap)
            x = x.assign(overlap=share)[share >= overlap]
            yield x.loc[[same_question(i, j) for i, j in zip(x["a"], x["b"], strict=True)], ["ta", "tb", "overlap"]]

    near = near.select("ta", "tb", "a", "b").mapInPandas(verify, "ta bigint, tb bigint, overlap double")
    equal = texts.filter("in_train AND in_eval").select(F.col("t").alias("ta"), F.col("t").alias("tb"), F.lit(1.0).alias("overlap"))
    return near.unionByName(equal), members


def cross_split_pairs(rows: DataFrame, id_col: str = "row_id", video: str = "video_id", problem: str = "problem", split: str = "split_name", train: tuple[str, ...] = ("train",), overlap: float = 0.4) -> DataFrame:
    """(train_id, eval_id, overlap) of rows on the same clip that ask the same question in different splits.

    Rows with a null or stand-in clip, split or text, or a text without words, are in no pair. Links between
    classes of equal wording are expanded at the end, so repeated rows give all their pairs.
    """
    links, members = question_links(rows, id_col, video, problem, split, train, overlap)
    left = members.filter("in_train").select(F.col("t").alias("ta"), F.col("id").alias("train_id"))
    right = members.filter("NOT in_train").select(F.col("t").alias("tb"), F.col("id").alias("eval_id"))
    return links.join(left, "ta").join(right, "tb").select("train_id", "eval_id", "overlap")


def record_overlaps(pairs: DataFrame) -> DataFrame:
    """(eval_id, overlap, partners): the largest overlap of every evaluation row that has a pair, and its pairs."""
    return pairs.groupBy("eval_id").agg(F.max("overlap").alias("overlap"), F.count(F.lit(1)).alias("partners"))
