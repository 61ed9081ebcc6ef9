"""Statistics of whole texts, computed for a batch of texts at once.

A batch is one array of code points; lines, tokens and words are ranges of it. Python looks only at lines
that may open with a bullet, at texts that may hold a table, and at blocks of three or more bare lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np

STATS = [
    "log_words", "word_length", "symbol_ratio", "line_end_share", "common_share", "digit_ratio", "upper_ratio", "distinct_share",
    "list_share", "table_share", "odd_ratio", "coded_share", "tag_share", "repeat_share", "menu_share", "pair_fit",
]
#: Words of the windows over which the share of distinct words is averaged.
DISTINCT_WORDS = 200
#: A run of four words is said over and over if it comes three times, and once in so many words of a long text.
REPEAT_WORDS = 400
#: Blocks of words in which a handful of words is looked for.
BABBLE_WORDS = 100
CELL_BITS = 22
#: Letters whose pairs are learnt: the most frequent ones.
LETTERS = 1024
#: A text belongs to the language with the most common words, if those are so large a share of its words.
LANGUAGE_WORDS = 0.1
#: Words of a menu lie next to a wide gap or a lone mark, with few common words and sentence ends among so many words around them.
MENU_WORDS, MENU_ANCHORS, MENU_COMMON = 20, 0.2, 0.3
#: Pairs of letters that a text's fit is weighed against.
PAIR_PRIOR = 20.0

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_BULLET = re.compile(r"\s*(?:[-*•–—·▪‣◦●○■□►>+✓✔]|\(?\d{1,4}[.):\]]|\[\d{1,4}\]|\[[ xX]\]|\(?[a-zA-Z][.)])\s+\S")
_RULE = re.compile(r"[\s|+\-=_:*]{4,}")
_PATH = re.compile(r"(?:[\w%~.+-]*[/\\])+[\w%~.+ -]*\.\w{2,5}$|https?://\S+$|www\.\S+$")
_WIDE, _STOP_AFTER = re.compile(r"[^\S\n]{2,}|\t|\s[^\w\s]\s"), re.compile(r"[\"'”’»)\]]*[.!?…。！？,](?:\s|$)")
_SPEECH = re.compile(r"\s*[^\W_][\w .'-]{0,18}:\s+\S")
_NORMAL = frozenset(" .,;:!?'\"()-–—“”‘’«»¿¡…/%&\n\r\t\xa0　、。·•")
_STOPS, _ENDS, _CLOSERS = ".!?…。！？", ".!?…。！？;:", "'\"”’»)]"
SEPARATORS = ("|", "\t", ";", ",", "gap")

SPACE, ALPHA, DIGIT, UPPER, LOWER, ODD, STOP, END, CLOSER, WORD = (1 << k for k in range(10))


def _is_odd(c: str) -> bool:
    """A symbol that prose hardly uses."""
    return not c.isalnum() and c not in _NORMAL and unicodedata.category(c) not in ("Mn", "Mc", "Cf")


def _class_bits(c: str) -> int:
    tests = (c.isspace(), c.isalpha(), c.isdigit(), c.isupper(), c.islower(), _is_odd(c), c in _STOPS, c in _ENDS, c in _CLOSERS, c.isalnum())
    return sum(1 << k for k, t in enumerate(tests) if t)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Classes of the characters of the basic plane as bits."""
    return np.array([_class_bits(chr(k)) if not 0xD800 <= k < 0xE000 else 0 for k in range(1 << 16)], dtype=np.uint16)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def classes_of(flat: np.ndarray) -> np.ndarray:
    bits = _class_table()[np.minimum(flat, 0xFFFF)]
    high = np.flatnonzero(flat > 0xFFFF)
    if len(high):
        kinds, where = np.unique(flat[high], return_inverse=True)
        bits[high] = np.array([_class_bits(chr(k)) for k in kinds], dtype=np.uint16)[where]
    return bits


def _running(mask: np.ndarray) -> np.ndarray:
    """Running counts with a zero before them, so that a difference counts a range."""
    out = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _count_in(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marked places in each of the ranges, which are in order and apart; cheap for few marks."""
    at = np.flatnonzero(mask)
    k = np.searchsorted(start, at, side="right") - 1
    return np.bincount(k[(k >= 0) & (at < end[k])], minlength=len(start)) if len(start) else np.zeros(0, np.int64)


def letter_pairs(lows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first letter, second letter) of all adjacent letters of lower-case texts, as code points."""
    flat = codes_of("\n".join(lows) + "\n")
    letter = (classes_of(flat) & ALPHA) > 0
    at = np.flatnonzero(letter[:-1] & letter[1:])
    ends = np.cumsum([len(t) + 1 for t in lows])
    return np.searchsorted(ends, at, side="right"), flat[at], flat[at + 1]


def _table_lines(counts: dict[str, list[int]], rule: list[bool], words: list[int]) -> list[bool]:
    """Lines that belong to a run of three or more rows with the same number of fields."""
    n = len(rule)
    out = [False] * n
    for sep, count in counts.items():
        if sum(map(bool, count)) < 3:
            continue
        at = 0
        while at < n:
            if not count[at] and not rule[at]:
                at += 1
                continue
            end = at
            while end < n and (count[end] or rule[end]):
                end += 1
            rows = [k for k in range(at, end) if not rule[k]]
            if len(rows) >= 3:
                mode, times = Counter(count[k] for k in rows).most_common(1)[0]
                near = sum(1 for k in rows if abs(count[k] - mode) <= (1 if sep == "gap" and mode > 1 else 0))
                if mode >= 1 and near >= 0.75 * len(rows) and (times >= 0.6 * len(rows) or sep == "gap"):
                    if sum(words[k] / (count[k] + 1) for k in rows) <= 6 * len(rows):
                        out[at:end] = [True] * (end - at)
            at = end
    return out


class _Lines:
    """The lines of a batch that are not blank, as arrays."""

    def __init__(self, joined: str, flat: np.ndarray, bits: np.ndarray, ends: np.ndarray) -> None:
        self.joined = joined
        stop_at = np.flatnonzero(flat == 10)
        start = np.concatenate([[0], stop_at[:-1] + 1])
        solid = (bits & SPACE) == 0
        ns = np.flatnonzero(solid)
        a, b = np.searchsorted(ns, start), np.searchsorted(ns, stop_at)
        real = a < b
        self.start, self.end = start[real], stop_at[real]
        self.first, self.last = ns[a[real]], ns[b[real] - 1]
        self.text = np.searchsorted(ends, self.start, side="right")
        self.size = self.last - self.first + 1
        at = self.last.copy()
        for _ in range(4):
            at = np.where((bits[at] & CLOSER > 0) & (at > self.first), at - 1, at)
        self.stops, self.ends = bits[at] & STOP > 0, bits[at] & END > 0
        word = (bits & WORD) > 0
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        self.words = _count_in(opens, self.start, self.end)
        # a stop after a letter, with more of the line behind it
        stop = np.flatnonzero((bits[1:] & STOP > 0) & (bits[:-1] & ALPHA > 0)) + 1
        q = stop.copy()
        for _ in range(3):
            nxt = np.minimum(q + 1, len(flat) - 1)
            q = np.where(bits[nxt] & CLOSER > 0, nxt, q)
        line = np.searchsorted(self.end, stop)
        line = np.minimum(line, max(0, len(self.end) - 1))
        inside = (bits[np.minimum(q + 1, len(flat) - 1)] & SPACE > 0) & (q < self.last[line]) if len(self.end) else np.zeros(0, bool)
        self.inner_stops = np.bincount(line[inside], minlength=len(self.end))
        self.inner = self.inner_stops > 0
        self.lower, self.upper = bits[self.first] & LOWER > 0, bits[self.first] & UPPER > 0
        self.fields = {}
        for sep in "|;\t,":
            self.fields[sep] = _count_in(flat == ord(sep), self.start, self.end)
        spaced = np.zeros(len(flat), bool)
        spaced[:-1] = (flat[:-1] == 44) & (flat[1:] == 32)
        loose = _count_in(spaced, self.start, self.end)
        self.fields[","] = np.where(loose * 2 <= self.fields[","], self.fields[","], 0)
        gap = np.zeros(len(flat), bool)
        space = ~solid
        gap[:-2] = solid[:-2] & space[1:-1] & (space[2:] | (flat[1:-1] == 9))
        self.fields["gap"] = _count_in(gap, self.first, self.last)
        self.second = flat[np.minimum(self.first + 1, len(flat) - 1)]
        self.third_space = bits[np.minimum(self.first + 2, len(flat) - 1)] & SPACE > 0
        self.letter = bits[self.first] & ALPHA > 0
        self.opening = flat[self.first]

    def line(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]]

    def entries(self) -> np.ndarray:
        """Lines that open with a bullet, number or letter mark and hold at most three sentences."""
        out = np.zeros(len(self.start), bool)
        may = np.flatnonzero(np.where(self.letter, np.isin(self.second, (46, 41)) & self.third_space, True) & (self.inner_stops < 3))
        out[may] = [_BULLET.match(self.line(i)) is not None for i in may.tolist()]
        return out

    def tables(self, n_texts: int) -> np.ndarray:
        """Lines that are rows of fields."""
        out = np.zeros(len(self.start), bool)
        may = np.zeros(n_texts, bool)
        for count in self.fields.values():
            may |= np.bincount(self.text[count > 0], minlength=n_texts) >= 3
        rule = np.isin(self.opening, [ord(c) for c in "|+-=_:*"])
        bounds = np.searchsorted(self.text, np.arange(n_texts + 1))
        for t in np.flatnonzero(may).tolist():
            a, b = int(bounds[t]), int(bounds[t + 1])
            rules = [bool(r) and bool(_RULE.fullmatch(x := self.line(a + k))) and len(set(x.strip())) <= 4 for k, r in enumerate(rule[a:b].tolist())]
            out[a:b] = _table_lines({s: c[a:b].tolist() for s, c in self.fields.items()}, rules, self.words[a:b].tolist())
        return out

    def bare_list(self, block: list[int]) -> bool:
        """Whether three or more lines without bullets are entries and not broken prose."""
        n = len(block)
        if n < 3 or self.inner[block].any() or self.size[block].max() > 110:
            return False
        stop = self.stops[block]
        stops = int(stop.sum())
        if stops >= 0.8 * n or sum(1 for i in block if _SPEECH.match(self.line(i))) > 0.5 * n:
            return False
        if stops == 0:
            return True
        low = self.lower[block][1:]
        carried, restarted = int((~stop[:-1] & low).sum()), int((stop[:-1] & low).sum())
        return restarted > 0 or (not self.upper[block][1:].any() and carried < n - 1) or carried == 0

    def kinds(self, n_texts: int, noise: np.ndarray) -> np.ndarray:
        """0 other, 1 list, 2 table, of every line; lines of noise are neither entries nor rows that stand alone."""
        table = self.tables(n_texts)
        marked = self.entries() & ~table & ~noise
        kind = np.where(table, 2, np.where(marked, 1, np.where(noise, 3, 0)))
        bullets = np.bincount(self.text[marked], minlength=n_texts)
        bare = np.flatnonzero(kind == 0)
        if len(bare):
            new = np.concatenate([[True], (np.diff(bare) > 1) | (self.text[bare[1:]] != self.text[bare[:-1]])])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(bare)))
            # a heading above entries or rows takes their kind
            for i in bare[starts[(sizes == 1)]].tolist():
                if i + 1 < len(kind) and self.text[i + 1] == self.text[i] and kind[i + 1] < 3 and self.size[i] <= 60:
                    kind[i] = kind[i + 1]
            short = (self.size <= 110) & ~self.inner
            for a, n in zip(starts[sizes >= 3].tolist(), sizes[sizes >= 3].tolist(), strict=True):
                block = bare[a : a + n]
                ok = short[block]
                if ok.all():
                    runs = [block]
                else:
                    # runs of six or more short lines
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
                    runs = [block[x:y] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if y - x >= 6]
                for r in runs:
                    if self.bare_list(r.tolist()):
                        kind[r] = 1
        total = np.bincount(self.text, minlength=n_texts)
        lone = marked & (bullets[self.text] == 1) & (total[self.text] > 1)
        return np.where((lone & (kind == 1)) | (kind == 3), 0, kind)


def _repeats(first: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Share of each text's words in runs of four that it says over and over, or in blocks of a handful of words."""
    n = len(first)
    hit = np.zeros(n, bool)
    if n >= 4:
        h = np.zeros(n - 3, dtype=np.uint64)
        for k in range(4):
            h = (h ^ first[k : n - 3 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = np.flatnonzero(owner[: n - 3] == owner[3:])
        # cells of a table first: most runs come once or twice
        cell = (h[whole] >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        whole = whole[np.bincount(cell, minlength=1 << CELL_BITS)[cell] >= 3]
        _, back, times = np.unique(h[whole], return_inverse=True, return_counts=True)
        often = whole[times[back] >= np.maximum(3, sizes[owner[whole]] / REPEAT_WORDS)]
        for k in range(4):
            hit[often + k] = True
    starts = np.cumsum(sizes) - sizes
    place = np.arange(n) - starts[owner]
    # the last block of a text takes what is left of it
    blocks = np.maximum(1, sizes // BABBLE_WORDS)
    block = (np.cumsum(blocks) - blocks)[owner] + np.minimum(place // BABBLE_WORDS, blocks[owner] - 1)
    size = np.bincount(block, minlength=int(blocks.sum()))
    kinds = np.bincount(np.unique(block * (n + 1) + first) // (n + 1), minlength=len(size))
    babble = (size >= 24) & (kinds <= np.maximum(6, 0.12 * size))
    hit |= babble[block]
    return np.bincount(owner[hit], minlength=len(sizes)) / np.maximum(1, sizes)


def distinct_shares(first: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Share of distinct words, averaged over all windows of DISTINCT_WORDS consecutive words; of fewer words, their own."""
    n = len(first)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(first, kind="stable")
    before = np.full(n, -1)
    again = first[order[1:]] == first[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    before = np.where(before < 0, -1, before - starts[owner])
    at, width = np.arange(n) - starts[owner], np.minimum(sizes, DISTINCT_WORDS)
    # a word counts in the windows that hold it and not the same word before it
    lo, hi = np.maximum(before + 1, at - width[owner] + 1), np.minimum(at, (sizes - width)[owner])
    windows = np.maximum(hi - lo + 1, 0)
    return np.bincount(owner, weights=windows, minlength=len(sizes)) / np.maximum(1, width * (sizes - width + 1))


class Wording:
    """What is learnt from a corpus: the common words of each language and how letters follow each other."""

    def __init__(self, common: dict[str, list[str]], pairs: np.ndarray) -> None:
        """``pairs`` holds rows of (first letter, second letter, times met)."""
        self.languages = sorted(common)
        self.place: dict[str, int] = {}
        for k, lang in enumerate(self.languages):
            for w in common[lang]:
                self.place[w] = self.place.get(w, 0) | (1 << k)
        a, b, n = (np.asarray(pairs[:, k], dtype=np.int64) for k in range(3))
        letters, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        met = np.bincount(back[: len(a)], weights=n, minlength=len(letters))
        top = np.sort(np.argsort(-met, kind="stable")[:LETTERS])
        self.letters = letters[top]
        first, total = met[top], float(met.sum())
        share = (first + 1.0) / (total + len(top))
        # a pair not met counts as if chance had brought it once in a hundred of its first letter
        self.fit = np.repeat(np.log2(100.0 / (first[:, None] + 100.0)), len(top), axis=1)
        x, y, ok = self._at(a, b)
        self.fit[x[ok], y[ok]] = np.log2((n[ok] / share[y[ok]] + 100.0) / (first[x[ok]] + 100.0))
        self.fit = np.clip(self.fit, -4.0, 4.0).astype(np.float32)
        self.mean = float((n[ok] * self.fit[x[ok], y[ok]]).sum() / n[ok].sum()) if ok.any() else 0.0

    def _at(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of both letters, and whether both are known."""
        if not len(self.letters):
            return np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        x, y = (np.minimum(np.searchsorted(self.letters, c), len(self.letters) - 1) for c in (a, b))
        return x, y, (self.letters[x] == a) & (self.letters[y] == b)

    def pair_fit(self, lows: list[str]) -> np.ndarray:
        """Mean of log2 P(next letter | letter) / P(next letter), drawn to the corpus mean where few known letters are met.

        Only letters that follow each other worse than in the corpus tell anything, so the mean is the most.
        """
        flat = codes_of("\n".join(lows) + "\n")
        k = len(self.letters)
        place = np.full(1 << 16, k, dtype=np.int32)
        low = self.letters < 1 << 16
        place[self.letters[low]] = np.flatnonzero(low)
        at = place[np.minimum(flat, 0xFFFF)]
        high = np.flatnonzero(flat > 0xFFFF)
        at[high] = np.where(np.isin(flat[high], self.letters), np.minimum(np.searchsorted(self.letters, flat[high]), k), k)
        known = np.zeros(len(flat), bool)
        known[:-1] = (at[:-1] < k) & (at[1:] < k)
        fit = np.zeros(len(flat), dtype=np.float32)
        pair = np.flatnonzero(known)
        fit[pair] = self.fit.ravel()[at[pair] * np.int64(k) + at[pair + 1]]
        starts = np.cumsum([0, *[len(t) + 1 for t in lows[:-1]]])
        n, total = np.add.reduceat(known, starts, dtype=np.int64), np.add.reduceat(fit, starts, dtype=np.float64)
        return np.minimum(self.mean, (total + PAIR_PRIOR * self.mean) / (n + PAIR_PRIOR))

    def menu_share(self, low: str) -> float:
        """Share of words next to a wide gap or lone mark, with few common words and sentence ends around them."""
        found = list(_WORD.finditer(low))
        n = len(found)
        starts, ends = [m.start() for m in found], [m.end() for m in found]
        apart = [low[a:b] for a, b in zip([0, *ends], [*starts, len(low)], strict=True)]
        wide = np.array([bool(_WIDE.search(x)) for x in apart])
        anchor = np.array([m.group() in self.place or _STOP_AFTER.match(x) is not None for m, x in zip(found, apart[1:], strict=True)])
        near = _running(anchor)
        at = np.arange(n)
        lo, hi = np.maximum(at - MENU_WORDS, 0), np.minimum(at + MENU_WORDS + 1, n)
        loose = near[hi] - near[lo] < MENU_ANCHORS * (hi - lo)
        return float((loose & (wide[:-1] | wide[1:])).mean()) if n else 0.0

    def common(self, flat_words: list[str], owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number or -1, share of its common words) of each text: the language with the most common words."""
        mask = np.fromiter(map(self.place.get, flat_words, repeat(0)), dtype=np.int64, count=len(flat_words))
        hits = np.stack([np.bincount(owner[(mask >> k) & 1 > 0], minlength=len(sizes)) for k in range(len(self.languages))], axis=1) if self.languages else np.zeros((len(sizes), 1))
        best = hits.argmax(axis=1)
        most = hits.max(axis=1)
        share = most / np.maximum(1, sizes)
        return np.where(share >= LANGUAGE_WORDS, best, -1), share


def describe_all(texts: list[str | None], wording: Wording) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(numbers of the texts that are not null, empty or blank, their language, words and statistics)."""
    keep = [k for k, t in enumerate(texts) if t is not None and t.strip()]
    real = [texts[k].replace("\r\n", "\n").replace("\r", "\n") for k in keep]
    m = len(real)
    if not m:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros((0, len(STATS)))
    lows = [t.lower() for t in real]
    words = [_WORD.findall(t) for t in lows]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(m), sizes)
    flat_words = [x for w in words for x in w]
    first = np.empty(len(flat_words), dtype=np.int64)
    at = 0
    for w in words:
        seen: dict[str, int] = {}
        first[at : at + len(w)] = np.fromiter(map(seen.setdefault, w, range(at, at + len(w))), dtype=np.int64, count=len(w))
        at += len(w)
    joined = "\n".join(real) + "\n"
    flat = codes_of(joined)
    bits = classes_of(flat)
    ends = np.cumsum([len(t) + 1 for t in real])
    starts = ends - np.array([len(t) + 1 for t in real])
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    solid, letters, digits, upper = count((bits & SPACE) == 0), count(bits & ALPHA > 0), count(bits & DIGIT > 0), count(bits & UPPER > 0)
    lines = _Lines(joined, flat, bits, ends)
    tokens = _tokens(joined, flat, bits)
    some = np.flatnonzero(tokens.coded | tokens.tag)
    in_line = np.searchsorted(lines.end, tokens.start[some])
    coded_size, tag_size = tokens.size[some] * tokens.coded[some], tokens.size[some] * tokens.tag[some]
    noise = np.bincount(in_line, weights=coded_size, minlength=len(lines.end))
    signs = _count_in(bits & ODD > 0, lines.start, lines.end)
    kind = lines.kinds(m, (noise > 0.5 * lines.size) | ((signs > 0.12 * lines.size) & (signs > 3)))
    by_text = lambda w: np.bincount(lines.text, weights=w, minlength=m)
    total = by_text(lines.size)
    listed, tabled = by_text(lines.size * (kind == 1)) / total, by_text(lines.size * (kind == 2)) / total
    # what lies in no entry and no row
    bare = kind == 0
    odd = np.bincount(lines.text, weights=signs * bare, minlength=m) / np.maximum(1, solid)
    line_of = lines.text[in_line]
    coded = np.bincount(line_of, weights=coded_size * bare[in_line], minlength=m)
    tagged = np.bincount(line_of, weights=tag_size * bare[in_line], minlength=m)
    language, common = wording.common(flat_words, owner, sizes)
    menus = np.zeros(m)
    # what is left of a list or a table is under half of the text
    for k in np.flatnonzero((common < MENU_COMMON) & (listed + tabled < 0.5)).tolist():
        menus[k] = wording.menu_share(lows[k])
    letters_of = np.array([sum(map(len, w)) for w in words])
    n_lines = np.bincount(lines.text, minlength=m)
    stats = np.stack(
        [
            np.log1p(sizes),
            letters_of / np.maximum(1, sizes),
            (solid - letters - digits) / np.maximum(1, solid),
            by_text(lines.ends) / n_lines,
            common,
            digits / np.maximum(1, solid),
            upper / np.maximum(1, letters),
            distinct_shares(first, owner, sizes),
            listed,
            tabled,
            odd,
            coded / np.maximum(1, solid),
            tagged / np.maximum(1, solid),
            _repeats(first, owner, sizes) * (1.0 - listed - tabled),
            menus * (1.0 - listed - tabled),
            wording.pair_fit(lows),
        ],
        axis=1,
    )
    return np.array(keep), [wording.languages[k] if k >= 0 else "other" for k in language.tolist()], sizes, stats


class _Tokens(NamedTuple):
    start: np.ndarray
    size: np.ndarray
    coded: np.ndarray
    tag: np.ndarray


def _tokens(joined: str, flat: np.ndarray, bits: np.ndarray) -> _Tokens:
    """Blank-separated tokens: whether they are encoded data, or tags, that is marked with signs or made of letters and digits."""
    solid = (bits & SPACE) == 0
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = b - a
    letter, digit = (bits & ALPHA) > 0, (bits & DIGIT) > 0
    joint = np.zeros(len(flat), bool)
    joint[1:] = (letter[1:] & digit[:-1]) | (digit[1:] & letter[:-1])
    joint |= flat == 95
    tag = (_count_in(joint, a, b) > 0) | (flat[a] == 35) | (flat[a] == 64)
    tag |= (size >= 3) & (flat[b - 1] == 33) & (flat[np.maximum(b - 2, 0)] == 33)
    coded = np.zeros(len(a), bool)
    long_ = np.flatnonzero(size >= 24)
    la, lb = a[long_], b[long_]
    long_ = long_[(_count_in(digit | (flat == 43) | (flat == 47) | (flat == 61), la, lb) > 0) & (_count_in(flat > 127, la, lb) == 0)]
    coded[long_] = [_PATH.search(joined[x:y]) is None for x, y in zip(a[long_].tolist(), b[long_].tolist(), strict=True)]
    may = np.flatnonzero(tag & ~coded & (_count_in((flat == 47) | (flat == 92), a, b) > 0))
    tag[may] = [_PATH.search(joined[x:y]) is None for x, y in zip(a[may].tolist(), b[may].tolist(), strict=True)]
    return _Tokens(a, size, coded, tag & ~coded)
