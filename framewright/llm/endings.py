"""Text cut off by field limits: a hashed logistic regression on how texts end.

Positives are made by cutting intact values at random places; features are closing characters and words,
punctuation, open quotes and brackets, ties to the answer options, and whether the length is a field
limit, that is one of the lengths that values pile up at. Every value is scored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 14
#: Share of the artificial cuts that are made at a limit of the field, where it has one.
AT_LIMIT = 0.6
#: Labelled rows the classifier is fitted on; every row is scored.
TRAIN_ROWS = 4000
#: A length is a limit if this share of all values has exactly it.
LIMIT_SHARE = 0.003
#: Lengths on either side that a limit stands out from.
NEAR_LENGTHS = 10

_MARKUP = re.compile(r"</?[A-Za-z_]{1,20}\s*>")
_LETTER = re.compile(r"[(\[]?([A-Ja-j])[)\].:]?")
_OPTION_MARK = re.compile(r"^\s*[(\[]?[A-J][)\].:]+\s*")
_LAST_LETTER = re.compile(r"(\S+?)\s*([:：→]\s*|\s)([(\[]?)([A-J])([)\]]?)$")
LETTERS = tuple("ABCDEFGHIJ")
_STOPS = ".!?。！？"
_CLOSERS = "”\"’'»)]*_"
_SAID = re.compile(r"(?:[^\W\d_]+\s+){0,3}[^\W\d_]+\s*[:：→]\s*[(\[]?[A-J][)\]]?\.?")
_AT_OPTION = re.compile(r"(?:^|\s)[A-J][:.)]\s[^.!?]{8,}$")
_NAMED = re.compile(r"(?:^|[\s(])[A-J](?:[:.)]|,\s*[“\"«])\s*")
_OPTION_LINE = re.compile(r"^\s*[(\[]?[A-J][)\].:]+\s*(\S.*)$")


def plain(text: str | None) -> str:
    """The text without tags and outer blanks, visible or not."""
    if not text:
        return ""
    return _MARKUP.sub(" ", text).strip(" \t\r\n\x0b\x0c\xa0​﻿　") if "<" in text else text.strip(" \t\r\n\x0b\x0c\xa0​﻿　")


def option_cores(options: Sequence[str | None] | None) -> list[str]:
    """Options in lower case without letter marks and closing stops."""
    if options is None:
        return []
    cores = [_OPTION_MARK.sub("", o).strip().rstrip(".").lower() for o in options if o]
    return [c for c in cores if c]


def options_of_prompt(prompt: str | None) -> list[str]:
    """Option cores of a prompt that lists its options one per line."""
    if not prompt:
        return []
    found = [_OPTION_LINE.match(x) for x in prompt.split("\n")[1:]]
    return option_cores([m.group(1) for m in found if m])


@lru_cache(maxsize=100_000)
def _slot(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "replace")) & (SIZE - 1)


def closing_class(s: str, cores: list[str]) -> str:
    """How a text closes, with its ties to the options."""
    low = s[-420:].lower()
    last = s[-1]
    if s[-12:].rstrip(" ])").endswith(("…", "...")):
        return "ellipsis"
    bare = low[-400:].rstrip(_CLOSERS + ".!")
    if any([len(c) > 3 and bare.endswith(c.rstrip(_CLOSERS + ".!")[-400:]) for c in cores]):
        return "option" if last not in _CLOSERS else "option_closed"
    if last in _STOPS or (last in _CLOSERS and len(s) > 1 and s[-2] in _STOPS):
        return "stop"
    if s[-1] in ")]" and s[-2:-1] in LETTERS and s[-3:-2] in ("(", "["):
        return "letter_in_brackets"
    if len(s) <= 3 and _LETTER.fullmatch(s):
        return "letter"
    m = _LAST_LETTER.search(s[-60:])
    if m:
        return "letter_marked" if m.group(2).strip() else "letter_loose"
    if last in _CLOSERS:
        return "closer"
    if last == "�":
        return "broken"
    if last.isdigit():
        return "digit"
    return "word" if last.isalpha() else "mark"


def features(s: str, cores: list[str], at_limit: bool, kind: str | None = None) -> list[int]:
    """Hashed features of a text that is not empty."""
    kind = kind or closing_class(s, cores)
    tail = s[-80:]
    mark = ""
    if kind in ("letter_marked", "letter_loose"):
        m = _LAST_LETTER.search(tail)
        mark = m.group(1).lower() if m else ""
    part = s[-400:]
    opened = (part.count("“") > part.count("”")) or part.count("(") > part.count(")") or part.count("«") > part.count("»")
    line = s.rsplit("\n", 1)[-1][-240:]
    at_option = line[-1:] not in _STOPS and bool(_AT_OPTION.search(line))
    out = [
        _slot("kind", kind),
        _slot("kind+limit", kind, at_limit),
        _slot("kind+open", kind, opened),
        _slot("kind+mark", kind, mark),
        _slot("at_option", kind, at_option, bool(cores)),
        _slot("1", s[-1]) if kind not in ("option", "option_closed") else _slot("1", kind),
    ]
    if kind not in ("option", "option_closed", "stop", "letter_in_brackets", "letter_marked"):
        words = re.findall(r"[^\W_]+|[^\w\s]", tail)
        out += [_slot("2", s[-2:]), _slot("3", s[-3:]), _slot("w", *[w.lower() for w in words[-1:]]), _slot("ww", *[w.lower() for w in words[-2:]])]
    return out


class Endings:
    """The fitted model."""

    def __init__(self, weights: np.ndarray, bias: float, limits: frozenset[int]) -> None:
        self.by_slot, self.bias, self.limits = weights.tolist(), bias, limits

    def score(self, s: str, cores: list[str], length: int, kind: str | None = None, limits: frozenset[int] | None = None) -> float:
        """Probability that the text was cut; 0 for an empty text. ``limits`` are those of its own field, the fitted field's by default."""
        if not s:
            return 0.0
        at, w = features(s, cores, length in (self.limits if limits is None else limits), kind), self.by_slot
        z = self.bias + sum([w[i] for i in at])
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def cut(self, s: str, cores: list[str], length: int, kind: str | None = None, limits: frozenset[int] | None = None) -> bool:
        return self.score(s, cores, length, kind, limits) > 0.5


def field_limits(df: DataFrame, texts: Sequence[Column]) -> frozenset[int]:
    """Lengths in characters at which an unusual share of the values of a field lies: at most 1 / LIMIT_SHARE of them.

    A limit has far more values than the lengths around it; short fields have many values at every length.
    """
    return limits_of_fields(df, {"": texts})[""]


def limits_of_fields(df: DataFrame, fields: dict[str, Sequence[Column]]) -> dict[str, frozenset[int]]:
    """``field_limits`` of several fields in one pass; only lengths that stand out come back."""
    cells = F.array(*[F.struct(F.lit(f).alias("f"), F.length(t).alias("n")) for f, ts in fields.items() for t in ts])
    counts = df.select(F.inline(cells)).filter("n > 0").groupBy("f", "n").agg(F.count(F.lit(1)).alias("c"))
    # lengths per field are few beside the rows; neighbours lie in one range of lengths
    near = counts.select("f", "c", F.col("n").alias("m"), F.explode(F.sequence(F.col("n") - NEAR_LENGTHS, F.col("n") + NEAR_LENGTHS)).alias("n")).filter("n <> m")
    around = near.groupBy("f", "n").agg((F.sum("c") / (2 * NEAR_LENGTHS)).alias("around"))
    whole = counts.groupBy("f").agg(F.sum("c").alias("total"))
    j = counts.join(whole, "f").join(around, ["f", "n"], "left")
    stands_out = (F.col("c") > F.greatest(F.lit(3.0), LIMIT_SHARE * F.col("total"))) & (F.col("c") > 3 * F.coalesce("around", F.lit(0.0)))
    out: dict[str, set[int]] = {f: set() for f in fields}
    for r in j.filter(stands_out).select("f", "n").collect():
        out[r.f].add(r.n)
    return {f: frozenset(v) for f, v in out.items()}


def _intact(s: str, cores: list[str]) -> bool:
    return closing_class(s, cores) in ("stop", "option", "option_closed", "letter_in_brackets", "letter_marked")


def fit_endings(samples: list[tuple[str, list[str]]], limits: frozenset[int], seed: int = 42, rounds: int = 400) -> Endings:
    """Fit on (text, option cores) pairs: intact ones as they are, and copies cut inside a word or sentence."""
    rng = random.Random(seed)
    rows, labels = [], []
    pile = sorted(limits)
    for text, cores in samples:
        s = plain(text)
        if len(s) < 40:
            continue
        kind = closing_class(s, cores)
        if not _intact(s, cores):
            continue
        if kind == "letter_marked" and not re.search(r"[^\W\d_]{3,}\W*$", _LAST_LETTER.search(s[-60:]).group(1)):
            continue
        rows.append(features(s, cores, len(text) in limits))
        labels.append(0)
        for _ in range(2):
            # at a limit of the field where the text is long enough, else anywhere
            fits = [n for n in pile if len(s) // 4 <= n <= len(text) - 2]
            raw = text[: rng.choice(fits)] if fits and rng.random() < AT_LIMIT else s[: rng.randint(len(s) // 4, len(s) - 2)]
            short = plain(raw)
            if short and short[-1] not in _STOPS and closing_class(short, cores) not in ("stop", "option", "option_closed"):
                ends = short + rng.choice(("…", "...", " [...]", "\ufffd")) if rng.random() < 0.08 else short
                rows.append(features(ends, cores, len(raw) in limits))
                labels.append(1)
    w, b = np.zeros(SIZE), 0.0
    if not rows:
        return Endings(w, -1.0, limits)
    n = max(map(len, rows))
    at = np.array([r + [SIZE] * (n - len(r)) for r in rows])
    y = np.array(labels, dtype=float)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, step = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1) + b, -30, 30)))
        g = balance * (p - y)
        grad = np.bincount(at.ravel(), weights=np.repeat(g, n), minlength=SIZE + 1) + 1e-5 * w
        grad[SIZE] = 0.0
        step += grad**2
        w -= 0.3 * grad / np.sqrt(step)
        b -= 2.0 * float(g.sum())
    return Endings(w[:SIZE], b, limits)


def bounded_sample(df: DataFrame, ids: Sequence[str], n: int) -> DataFrame:
    """At most ``n`` rows, the first in a random order that the ids fix.

    A hash threshold thins the rows before they are ordered, so that what reaches the driver stays near
    ``n`` rows however many partitions there are.
    """
    share = min(1.0, 1.25 * n / max(1, df.count()))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(17), *ids), 1)
    return df.filter(h <= F.lit(min(2**63 - 1, int(share * 2.0**63)))).orderBy(h, *ids).limit(n)


def sampled_texts(df: DataFrame, text: str, options: str, ids: Sequence[str], n: int = TRAIN_ROWS) -> list[tuple[str, list[str]]]:
    """Texts with their option cores, from a bounded sample of the rows."""
    rows = bounded_sample(df.select(text, options, *ids), ids, n).collect()
    return [(r[text], option_cores(r[options])) for r in rows if r[text] and len(r[text]) > 80]


def short_answer(a: str, cores: list[str]) -> str | None:
    """"sound" for a letter or a whole option, "cut" for the beginning of an option, None for anything else."""
    s = plain(a)
    if not s:
        return "sound"
    if len(s) <= 3 and _LETTER.fullmatch(s):
        return "sound"
    if len(s) <= 80 and _SAID.fullmatch(s):
        return "sound"
    marked = _OPTION_MARK.match(s) is not None
    core = _OPTION_MARK.sub("", s).strip().lower()
    whole = core.rstrip(".").strip()
    if whole in cores:
        return "sound"
    begun = core.removesuffix("…").removesuffix("...").rstrip()
    if begun and (begun != core or marked or len(begun) >= 3) and any(c.startswith(begun) and c != begun for c in cores) and core[-1] not in "!?":
        return "cut"
    named = list(_NAMED.finditer(s))
    if named and not marked:
        rest = s[named[-1].end() :].lower().removesuffix("…").removesuffix("...").strip(" “\"«")
        if rest.rstrip(_CLOSERS + ".") in cores:
            return "sound"
        if rest and any(c.startswith(rest) for c in cores):
            return "cut"
    # with the options known, a marked text that begins none of them is another text in full
    return "sound" if marked and cores and begun == core else None
