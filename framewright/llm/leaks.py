"""Evaluation texts leaking into training text.

Word n-grams of the test items form a broadcast hash table; every document's windows are scanned against
it, and hits are verified by aligning the words around them. The items are a parameter table whose text is
of bounded size; the corpus is never shuffled. Leaking documents can be dropped, or the leaking spans cut out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.quality import slices

#: Characters of the items' text that are collected and broadcast; more is an error.
MAX_ITEM_CHARS = 64_000_000
#: Places of the words of a window: five in a row, or three and three around a word that may be misspelt.
WINDOWS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5, 6))
GRAM = 5
LEAK_WORDS = 15
#: General wording is a whole first or last line of more than SHARED_BY items, or a run of SHARED_GRAM words
#: in more than SHARED_BY scenes; among many items, of more than SHARED_SHARE of them.
SHARED_GRAM, SHARED_BY, SHARED_SHARE = 8, 5, 0.02
#: Items that share so much of the one with fewer words are about one scene; so many of an item's rarest runs are looked at.
SCENE_SHARE, SCENE_LINKS = 0.5, 8
GAP = 10
#: Words in a row around a hit that may be the item's, and equal ones among them, for which words are aligned; around an
#: interruption or a word in two parts two such rows on near diagonals make up the first number, less GAP_LOSS.
ROW_WORDS, EQUAL_WORDS, GAP_LOSS = 15, 9, 3

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_BREAK = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)")
_TOKEN = re.compile(r"</?[A-Za-z][^<>]{0,200}>|[^\s<]+|<")
PAIRS, PAIR_BITS, NO_WORD = 250_000, 20, (1 << 64) - 1
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words in a plain spelling: no case, punctuation, markup, invisible characters or compatibility forms."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = unicodedata.normalize("NFKC", text)
    text = "".join([c for c in text if c.isalnum() or unicodedata.category(c) not in ("Cf", "Mn")]) if _ODD.search(text) else text
    return _WORD.findall(text.casefold())


_ODD = re.compile("[­​-‏‪-‮⁠-⁤﻿̀-ͯ︀-️]")


def near_word(a: str, b: str) -> bool:
    """Whether one word is a misspelling of the other: one letter lost, added, changed or two swapped."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1 or max(n, m) < 3:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


def own_wording(words: list[tuple[str, ...]], lines: list[tuple[int, int]]) -> list[np.ndarray]:
    """Of each item, which words are its own and no general wording; ``lines`` are the words of its first and last line.

    Sibling items on one scene share most of their words, items with one instruction line only that line.
    So items are joined to scenes before runs are counted: over the rarest runs an item shares, where the
    overlap with the first item of that run is SCENE_SHARE of the words of the shorter one.
    """
    most = max(SHARED_BY, SHARED_SHARE * len(words))
    whole = Counter(x for w, (a, b) in zip(words, lines, strict=True) for x in {w[:a], w[len(w) - b :]} if SHARED_GRAM <= len(x) < len(w))
    number = {x: k + 1 for k, x in enumerate(sorted({x for w in words for x in w}))}
    owner, grams = [], []
    for t, w in enumerate(words):
        if len(w) >= SHARED_GRAM:
            ids = np.array([number[x] for x in w], dtype=np.uint64)
            h = np.zeros(len(w) - SHARED_GRAM + 1, dtype=np.uint64)
            for k in range(SHARED_GRAM):
                h = (h ^ ids[k : len(w) - SHARED_GRAM + 1 + k]) * _P
                h ^= h >> np.uint64(31)
            grams.append(h)
            owner.append(np.full(len(h), t))
    own = [np.ones(len(w), dtype=bool) for w in words]
    for mine, w, (a, b) in zip(own, words, lines, strict=True):
        mine[:a] &= whole[w[:a]] <= most
        mine[len(w) - b :] &= whole[w[len(w) - b :]] <= most
    if not grams:
        return own
    gram, item = np.concatenate(grams), np.concatenate(owner)
    keys, key = np.unique(gram, return_inverse=True)
    once = np.unique(key * len(words) + item)
    held = np.bincount(once // len(words), minlength=len(keys))
    first = np.full(len(keys), len(words))
    np.minimum.at(first, key, item)
    scene = list(range(len(words)))

    def root(k: int) -> int:
        while scene[k] != k:
            scene[k] = scene[scene[k]]
            k = scene[k]
        return k

    bounds = np.searchsorted(item, np.arange(len(words) + 1))
    sets = [set(w) for w in words]
    for t in range(len(words)):
        mine = np.unique(key[bounds[t] : bounds[t + 1]])
        mine = mine[(held[mine] > 1) & (first[mine] < t)]
        rare = mine[np.argsort(held[mine], kind="stable")[:SCENE_LINKS]]
        for other in set(first[rare].tolist()):
            if len(sets[t] & sets[other]) >= SCENE_SHARE * min(len(sets[t]), len(sets[other])) and np.isin(mine, key[bounds[other] : bounds[other + 1]]).sum() + SHARED_GRAM - 1 >= SCENE_SHARE * min(len(words[t]), len(words[other])):
                scene[root(t)] = root(other)
    roots = np.array([root(k) for k in range(len(words))])
    spread = np.bincount(np.unique(key * len(words) + roots[item]) // len(words), minlength=len(keys))
    place = np.arange(len(item)) - bounds[item]
    for t, at in zip(item[spread[key] > most].tolist(), place[spread[key] > most].tolist(), strict=True):
        own[t][at : at + SHARED_GRAM] = False
    return own


class ItemIndex:
    """Items, the n-grams of their own wording, and the alignment that verifies a hit."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        by_words: dict[tuple[str, ...], list[int]] = defaultdict(list)
        ends: dict[tuple[str, ...], tuple[int, int]] = {}
        for item, text in items:
            w = tuple(words_of(text or ""))
            by_words[w].append(item)
            if w and w not in ends:
                rows = [x for x in (text or "").splitlines() if x.strip()]
                ends[w] = (len(words_of(rows[0])), len(words_of(rows[-1]))) if len(rows) > 1 else (0, 0)
        by_words.pop((), None)
        self.words = list(by_words)
        self.ids = list(by_words.values())
        self.own = own_wording(self.words, [ends[w] for w in self.words])
        self.number = {x: k + 1 for k, x in enumerate(sorted({x for w in self.words for x in w}))}
        grams = []
        for t, (w, own) in enumerate(zip(self.words, self.own, strict=True)):
            ids = np.array([self.number[x] for x in w], dtype=np.uint64)
            for k, window in enumerate(WINDOWS):
                if len(ids) > window[-1]:
                    ok = np.lib.stride_tricks.sliding_window_view(own, window[-1] + 1).all(axis=1)
                    at = np.flatnonzero(ok)
                    grams.append(np.stack([self.hashes(ids, k)[at], np.full(len(at), t, np.uint64), at.astype(np.uint64)]))
        g = np.concatenate(grams, axis=1) if grams else np.zeros((3, 0), np.uint64)
        g = g[:, np.lexsort((g[2], g[1], g[0]))]
        self.keys, self.first, self.count = np.unique(g[0], return_index=True, return_counts=True)
        self.text, self.pos = g[1].astype(np.int64), g[2].astype(np.int64)
        # all items one after another, with room between them, for counting equal words on a diagonal
        self.start = np.cumsum([LEAK_WORDS, *[len(w) + LEAK_WORDS for w in self.words]])[: len(self.words)].astype(np.int64)
        self.flat = np.full(int(sum(map(len, self.words))) + LEAK_WORDS * (len(self.words) + 1), NO_WORD, dtype=np.uint64)
        # pairs of items' words that may be each other's misspelling, as a table of bits: they share the word or one less a letter
        less: dict[str, list[int]] = defaultdict(list)
        for x, k in self.number.items():
            for part in {x, *(x[:c] + x[c + 1 :] for c in range(len(x)))}:
                less[part].append(k)
        name = dict(zip(self.number.values(), self.number, strict=True))
        pairs = {(a, b) for group in less.values() for a in group for b in group if a < b and near_word(name[a], name[b])}
        self.near = np.zeros(1 << PAIR_BITS, dtype=bool)
        if pairs:
            self.near[self._pair(*(np.array(c, dtype=np.uint64) for c in zip(*pairs, strict=True)))] = True
        self.flat_own = np.zeros(len(self.flat), dtype=bool)
        for t, w in enumerate(self.words):
            self.flat_own[self.start[t] : self.start[t] + len(w)] = self.own[t]
            self.flat[self.start[t] : self.start[t] + len(w)] = [self.number[x] for x in w]
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def hashes(ids: np.ndarray, which: int) -> np.ndarray:
        window = WINDOWS[which]
        h = np.full(max(0, len(ids) - window[-1]), which + 1, dtype=np.uint64)
        for k in window:
            h = (h ^ ids[k : k + len(h)]) * _P
            h ^= h >> np.uint64(31)
        return h

    def scan(self, docs: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """(document number, text number, first word, word after the last) of verified leaks: the first of each text in a document."""
        return self._scan(docs, every=False)

    def spans(self, docs: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """As ``scan``, with all passages of a text in a document."""
        return self._scan(docs, every=True)

    def _scan(self, docs: list[list[str]], every: bool) -> list[tuple[int, int, int, int]]:
        number = self.number
        flat = np.array([number.get(x, 0) for d in docs for x in [*d, ""]], dtype=np.uint64)
        if not len(docs):
            return []
        if len(flat) < GRAM or not len(self.keys):
            return []
        ends = np.cumsum([len(d) + 1 for d in docs])
        starts = ends - np.array([len(d) + 1 for d in docs])
        known = np.concatenate([[0], np.cumsum(flat != 0)])
        padded = np.concatenate([np.zeros(LEAK_WORDS, np.uint64), flat, np.zeros(LEAK_WORDS, np.uint64)])
        found: list[np.ndarray] = []
        for which, window in enumerate(WINDOWS):
            h = self.hashes(flat, which)
            span = window[-1] + 1
            full = known[span:] - known[:-span] >= len(window)
            at = np.flatnonzero(full & self.filter[(h >> np.uint64(42)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            real = self.keys[slot] == h[at]
            at, slot = at[real], slot[real]
            # a frequent window meets many items, so its pairs are made and counted in slices
            many = np.cumsum(self.count[slot])
            bounds = np.searchsorted(many, np.arange(PAIRS, int(many[-1]) + PAIRS, PAIRS)) + 1 if len(many) else []
            for a, b in zip([0, *bounds], [*bounds], strict=False):
                sub, place, m = slot[a:b], at[a:b], self.count[slot[a:b]]
                ref = np.repeat(self.first[sub] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                x, t, y = np.repeat(place, m), self.text[ref], self.pos[ref]
                i = self.start[t] + y
                if which == 0:
                    # the first hit of a run of own wording stands for it
                    new = (padded[x + LEAK_WORDS - 1] != self.flat[i - 1]) | ~self.flat_own[i - 1]
                else:
                    # with the word between alike, it is a run
                    new = padded[x + LEAK_WORDS + 3] != self.flat[i + 3]
                x, t, y, i = x[new], t[new], y[new], i[new]
                row, equal = self._rows(padded, x, i)
                found.append(np.stack([x, t, y, row, equal])[:, row > GRAM - 1])
        x, t, y, row, equal = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
        doc = np.searchsorted(ends, x, side="right")
        order = np.lexsort((x, t, doc))
        x, t, y, row, equal, doc = x[order], t[order], y[order], row[order], equal[order], doc[order]
        shift = np.abs(np.diff(x - y))
        beside = (doc[1:] == doc[:-1]) & (t[1:] == t[:-1]) & (shift > 0) & (shift <= GAP + 2) & (np.diff(x) <= 2 * LEAK_WORDS) & (row[1:] + row[:-1] >= ROW_WORDS - GAP_LOSS)
        near = (row >= ROW_WORDS) & (equal >= EQUAL_WORDS)
        near[1:] |= beside
        near[:-1] |= beside
        x, t, y, doc = x[near], t[near], y[near], doc[near]
        out: list[tuple[int, int, int, int]] = []
        last, covered = (-1, -1), -1
        for d, k, a, b in zip(doc.tolist(), t.tolist(), (x - starts[doc]).tolist(), y.tolist(), strict=True):
            if (d, k) != last:
                last, covered = (d, k), -1
            if a < covered:
                continue
            words, begin, end = self.passage(docs[d], k, a, b)
            if words >= LEAK_WORDS:
                out.append((d, k, begin, end))
                covered = end if every else 1 << 62
        return out

    def _rows(self, padded: np.ndarray, x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in a row around each hit that may be the item's, up to LEAK_WORDS - 1 on either side, and how many are equal.

        A word may be another one's misspelling if no item has it, or if two items have words so near.
        """
        row, equal = np.ones(len(x), dtype=np.int64), np.ones(len(x), dtype=np.int64)
        for step in (1, -1):
            live = np.arange(len(x))
            for k in range(1, LEAK_WORDS):
                a, b = padded[x[live] + LEAK_WORDS + step * k], self.flat[i[live] + step * k]
                same = a == b
                on = same | ((a == 0) & (b < NO_WORD)) | self.near[self._pair(a, b)]
                live, same = live[on], same[on]
                row[live] += 1
                equal[live[same]] += 1
        return row, equal

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (((np.minimum(a, b) * _P) ^ np.maximum(a, b)) * _P >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def passage(self, d: list[str], t: int, x: int, y: int) -> tuple[int, int, int]:
        """Words in a row of the item's own wording met around document word x and item word y; where they begin and end."""
        w, own = self.words[t], self.own[t]
        right, end = self._run(d, w, own, x, y, 1)
        left, begin = self._run(d, w, own, x - 1, y - 1, -1)
        return right + left, begin + 1, end

    @staticmethod
    def _run(d: list[str], w: tuple[str, ...], own: np.ndarray, x: int, y: int, step: int) -> tuple[int, int]:
        def same(i: int, j: int) -> bool:
            return 0 <= i < len(d) and 0 <= j < len(w) and d[i] == w[j]

        n = clean = 0
        clean = GRAM
        while 0 <= x < len(d) and 0 <= y < len(w) and own[y]:
            if d[x] == w[y]:
                n, clean, x, y = n + 1, clean + 1, x + step, y + step
                continue
            if clean < 2:
                break
            two = d[x] + d[x + step] if step == 1 and x + 1 < len(d) else d[x - 1] + d[x] if step == -1 and x > 0 else ""
            if two == w[y] and two:
                n, x, y = n + 1, x + 2 * step, y + step
            elif near_word(d[x], w[y]):
                n, clean, x, y = n + 1, 0, x + step, y + step
            elif 0 <= y + step < len(w) and d[x] == (w[y] + w[y + step] if step == 1 else w[y + step] + w[y]):
                n, x, y = n + 2, x + step, y + 2 * step
            else:
                for gap in range(1, GAP + 1):
                    if same(x + gap * step, y) and same(x + (gap + 1) * step, y + step):
                        x, clean = x + gap * step, 0
                        break
                else:
                    break
        return n, x


def item_index(items: DataFrame, item_id: str, item_text: str) -> ItemIndex:
    """Index of the items. Their text must not exceed MAX_ITEM_CHARS, else it is an error."""
    size = items.agg(F.sum(F.coalesce(F.length(item_text), F.lit(0)) + 16)).collect()[0][0] or 0
    if size > MAX_ITEM_CHARS:
        raise ValueError(f"the test items hold more than {MAX_ITEM_CHARS} characters; pass them in several tables")
    return ItemIndex([(r[0], r[1]) for r in items.select(item_id, item_text).collect()])


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id) of documents that hold LEAK_WORDS or more words in a row of an item's own wording.

    Passages of SHARED_GRAM words that more than SHARED_BY scenes share are general wording and never count.
    Items of the same wording are found together. Null, empty and short texts give no rows. Items of more
    than MAX_ITEM_CHARS characters are an error.
    """
    index = docs.sparkSession.sparkContext.broadcast(item_index(items, item_id, item_text))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for b in batches:
            ids, texts = b[doc_id].to_numpy(), b[doc_text].tolist()
            for a, z in slices(texts, 4_000_000):
                hits = ix.scan([words_of(t or "") for t in texts[a:z]])
                found = [(ids[a + k], i) for k, t, _, _ in hits for i in ix.ids[t]]
                yield pd.DataFrame({"d": [f[0] for f in found], "i": [f[1] for f in found]}).astype("int64")

    out = docs.select(doc_id, doc_text).mapInPandas(scan, "d bigint, i bigint")
    return out.withColumnsRenamed({"d": doc_id, "i": item_id})


def placed_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in a plain spelling, and the range of characters of the token each stands in."""
    words, places = [], []
    for m in _TOKEN.finditer(text):
        for w in words_of(m.group()):
            words.append(w)
            places.append(m.span())
    return words, places


def cut_spans(text: str | None, index: ItemIndex) -> tuple[str | None, int]:
    """The text without the passages of items, and how many ranges were cut."""
    if not text:
        return text, 0
    words, places = placed_words(text)
    out, kept_to, cuts = [], 0, 0
    for begin, end in sorted({(a, b) for _, _, a, b in index.spans([words])}):
        a, b = places[begin][0], places[end - 1][1]
        if b > kept_to:
            out.append(text[kept_to : max(a, kept_to)])
            kept_to, cuts = b, cuts + 1
    return "".join(out) + text[kept_to:], cuts


def without_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text, n_cuts) of all documents, with the leaking passages cut out of their texts."""
    index = docs.sparkSession.sparkContext.broadcast(item_index(items, item_id, item_text))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [cut_spans(t, index.value) for t in b["t"]]
            yield pd.DataFrame({"d": b["d"], "t": pd.Series([g[0] for g in got], dtype=object, index=b.index), "n": pd.Series([g[1] for g in got], dtype="int64", index=b.index)})

    out = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).alias("t")).mapInPandas(clean, "d bigint, t string, n bigint")
    return out.withColumnsRenamed({"d": doc_id, "t": doc_text, "n": "n_cuts"})


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no leaked passage; those with a null id stay."""
    return docs.join(found.select(doc_id).distinct(), doc_id, "left_anti")
