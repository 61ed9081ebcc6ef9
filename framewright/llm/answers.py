"""Broken prompt and response pairs: empty, truncated, refused, copied or foreign answers.

One pass labels what a response shows by itself. Refusals show in the crowd: response openings are
clustered by MinHash over five-word shingles, verified at a similarity of 0.8; a prefix filter over the
rarest shingles then finds the similar pairs that are still in different clusters. A cluster that recurs
under unrelated prompts while its responses hardly ever reach an answer is a refusal template.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import endings as E
from framewright.llm.chunking import mix64
from framewright.llm.related import components
from framewright.llm.truncation import truncation_model
from framewright.session import cut

FIELDS = ("answer_raw", "cot_raw", "long_cot_raw")
#: Words of the first sentence that make an opening.
OPENING_WORDS = 24
#: Sentences among which the opening is looked for.
OPENING_SENTENCES = 4
SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 8, 3
COUNTER_BITS = 16
#: Last words of a sentence that count as a template too, as templates vary in how they begin.
TAIL_WORDS = 8
#: Unrelated prompts under which a template recurs, and how many of its responses may reach an answer.
PROMPTS, ANSWERED = 3, 0.2
LANGUAGE_ROWS = 4000
WORD_CACHE = 200_000

# Spellings of "nothing" (fixed values).
FILLERS = frozenset("empty,n a,na,nan,nil,no answer,none,null,tbd,todo,undefined,unknown,keine,leer,ninguna,ninguno,nada,aucun,aucune,rien,vide,없음".split(","))

_WORDS = re.compile(r"[^\W_]+")
_HANGUL = re.compile(r"[가-힣]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"”’»)]*\s+|\n+")
_LETTER_NEAR_END = re.compile(r"(?:[Oo]ption|[Oo]pción)\s+[A-J](?!\w)|(?<![\w'’])[A-HJ](?=번|이다|[.!:,)”]|\W*$)")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class Languages:
    """Naive Bayes over words and their edges, fitted on questions and responses with a known language."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in samples:
            counts[lang].update(self.tokens(words_of(text)))
        vocabulary = {t for c in counts.values() for t in c}
        self.names = sorted(counts)
        totals = np.array([sum(counts[k].values()) + 0.5 * len(vocabulary) for k in self.names]) if self.names else np.zeros(0)
        # a score per language, Korean words, words that are no numbers: of tokens, and of words met so far
        self.score: dict[str, int] = {t: k for k, t in enumerate(vocabulary)}
        self.scores = np.zeros((len(vocabulary), len(self.names) + 2))
        for t, k in self.score.items():
            row = np.array([counts[n][t] + 0.5 for n in self.names]) / totals
            self.scores[k, :-2] = np.clip(np.log(row / row.mean()), -3, 3)
        self.rows = np.zeros((1024, len(self.names) + 2))
        self.place: dict[str, int] = {}

    @staticmethod
    def tokens(words: list[str]) -> list[str]:
        out = []
        for w in words:
            if not w.isdigit():
                out += [w, "^" + w[:2], "$" + w[-2:]]
        return out

    def _learn(self, words: list[str]) -> None:
        if len(self.place) + len(words) > WORD_CACHE:
            self.place = {}
        first, many = len(self.place), len(words)
        # room grows by doubling, so that few words at a time cost no copies of all rows
        if first + many > len(self.rows):
            self.rows = np.concatenate([self.rows[:first], np.zeros((max(first, many, 1024), self.rows.shape[1]))])
        made = self.rows[first : first + many]
        made[:] = 0.0
        at, of = [], []
        for k, w in enumerate(words):
            for x in self.tokens([w]):
                if (i := self.score.get(x)) is not None:
                    at.append(k)
                    of.append(i)
        np.add.at(made, at, self.scores[of])
        made[:, -2] = [_HANGUL.search(w) is not None for w in words]
        made[:, -1] = [not w.isdigit() for w in words]
        self.place.update(zip(words, range(first, first + many), strict=True))

    def guess(self, words: list[str]) -> tuple[str | None, float]:
        """(language, lead over the next in log odds) of the words of a text in lower case; None without words to go by."""
        if len(self.names) < 2 or not words:
            return None, 0.0
        try:
            at = list(map(self.place.__getitem__, words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in self.place]
            if len(self.place) + len(new) > WORD_CACHE:
                new = list(dict.fromkeys(words))
            self._learn(new)
            at = list(map(self.place.__getitem__, words))
        *z, korean, spoken = self.rows.take(at, axis=0).sum(axis=0).tolist()
        if spoken == 0:
            return None, 0.0
        if korean * 2 > spoken:
            return "ko", 99.0
        second, first = sorted(z)[-2:]
        return (self.names[z.index(first)], first - second) if first > second else (None, 0.0)


_NAMES_OPTION = frozenset(("option", "option_closed", "letter", "letter_in_brackets", "letter_marked"))


def reaches_answer(s: str, kind: str, state: str | None) -> bool:
    """Whether a response names an option, by letter or by wording, at its end or alone."""
    return kind in _NAMES_OPTION or state is not None or bool(_LETTER_NEAR_END.search(s[-42:]))


def copies_question(s: str, a: list[str], question: list[str], cores: list[str]) -> bool:
    """Whether a response only says the question again, perhaps with a lead-in, its options or twice."""
    if len(question) < 3 or not a:
        return False
    q = " ".join(question)
    if len(a) > 3 * (len(question) + sum(len(c.split()) for c in cores)) + 20:
        return False
    text = f" {' '.join(a)} "
    if f" {q} " not in text:
        return len(a) >= 5 and len(a) >= 0.6 * len(question) and q.startswith(" ".join(a)[:-1])
    rest = text.replace(f" {q} ", " ")
    rest = rest.replace(f" {q} ", " ")
    for c in sorted(cores, key=len, reverse=True):
        w = " ".join(words_of(c))
        if len(w) > 2:
            rest = rest.replace(f" {w} ", " ")
    left = rest.split()
    begun = rest.strip()
    if len(begun) > 3 and (q.startswith(begun) or any(" ".join(words_of(c)).startswith(begun.split(" ", 1)[-1]) for c in cores)):
        return True
    if E.closing_class(s, []) in ("letter_marked", "letter_in_brackets") and len(left) <= 4:
        return False
    return sum(1 for w in left if len(w) > 1) <= 7


def label(s: str, w: list[str], text: str, question: list[str], q_lang: str | None, cores: list[str], model: E.Endings, languages: Languages, kind: str, state: str | None, limits: frozenset[int]) -> str | None:
    """What a response shows by itself; None for sound ones and refusals. ``kind`` is how it closes, ``state`` what it is as a short answer."""
    if not w or (len(w) <= 3 and " ".join(w) in FILLERS):
        return "empty"
    if state == "cut":
        return "truncated"
    if copies_question(s, w, question, cores):
        return "copies_question"
    if len(s) < 400 and E._OPTION_MARK.sub("", s).strip().rstrip(".").lower() in cores or (state == "sound" and len(w) <= 5):
        return None
    if len(w) <= 6 and reaches_answer(s, kind, state):
        return None
    if q_lang and len(w) >= 4:
        lang, lead = languages.guess(w)
        if lang and lang != q_lang and lead > 6.0:
            return "other_language"
    if state == "sound":
        return None
    return "truncated" if model.cut(s, cores, len(text), kind, limits) else None


def opening_of(sentences: list[list[str]], question: set[str]) -> str:
    """The first sentence that doesn't restate the question, at most OPENING_WORDS words of it."""
    for w in sentences:
        # a lead-in names things of the question; a template does not
        if w and (len(w) < 6 or sum([x in question for x in w[4:]]) < 0.6 * len(w[4:])):
            return " ".join(w[:OPENING_WORDS])
    return ""


def keys_of(s: str, question: set[str]) -> list[str]:
    """The opening of a response, its first sentences and their last words, as templates vary in how they begin."""
    sentences = [words_of(part) for part in _SENTENCE.split(s, maxsplit=OPENING_SENTENCES)[:OPENING_SENTENCES]]
    keys = {opening_of(sentences, question)}
    for w in sentences:
        w = w[:OPENING_WORDS]
        if len(w) >= 4:
            keys.add(" ".join(w))
        if TAIL_WORDS <= len(w) < OPENING_WORDS:
            keys.add("~ " + " ".join(w[-TAIL_WORDS:]))
    return sorted(keys - {""})


def key_hash(key: str) -> int:
    """``xxhash64`` of the key as the engine computes it."""
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def minhash_bands(openings: DataFrame) -> DataFrame:
    """(band, opening) from hashes of the five-word shingles; shorter openings are one shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = mix64(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))
        for b in batches:
            bands, texts = [], []
            for t in b["opening"]:
                h = np.array([zlib.crc32(x.encode()) for x in shingles(t)], dtype=np.uint64)
                low = mix64(h[:, None] ^ seeds).min(axis=0).reshape(BANDS, BAND_ROWS)
                key = mix64((low * np.array([1, 31, 961], dtype=np.uint64)).sum(axis=1) ^ seeds[:BANDS])
                bands += key.view(np.int64).tolist()
                texts += [t] * BANDS
            yield pd.DataFrame({"band": pd.Series(bands, dtype="int64"), "opening": pd.Series(texts, dtype=object)})

    return openings.mapInPandas(run, "band bigint, opening string")


def shingles(text: str) -> set[str]:
    w = text.split(" ")
    return {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


def shingle_counters(openings: DataFrame) -> np.ndarray:
    """Shingle counts of all openings in 2**COUNTER_BITS cells: a table of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for b in batches:
            cells = [zlib.crc32(x.encode()) >> (32 - COUNTER_BITS) for t in b["opening"] for x in shingles(t)]
            total += np.bincount(np.array(cells, dtype=np.int64), minlength=1 << COUNTER_BITS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    out = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    for r in openings.mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def rare_shingles(openings: DataFrame, counters: np.ndarray) -> DataFrame:
    """(k, size, opening, root): of each opening its rarest shingles, until the rest are too few for SIMILARITY.

    Two similar openings share one of them, whatever the order of the shingles; rare ones make few pairs.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, root in zip(b["opening"], b["root"], strict=True):
                ranked = sorted((int(counters[h >> (32 - COUNTER_BITS)]), h, x) for h, x in ((zlib.crc32(x.encode()), x) for x in shingles(t)))
                n = len(ranked)
                out += [(h, n, t, root) for _, h, _ in ranked[: n - math.ceil(SIMILARITY * n) + 1]]
            yield pd.DataFrame(out, columns=["k", "size", "opening", "root"])

    return openings.select("opening", "root").mapInPandas(pick, "k bigint, size int, opening string, root string")


def clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster): openings joined by chains of similar pairs. ``opening`` must be distinct."""

    @F.pandas_udf("boolean")
    def alike(p: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(p, q, strict=True):
            x, y = shingles(a), shingles(b)
            out.append(len(x & y) >= SIMILARITY * len(x | y))
        return pd.Series(out, dtype=bool)

    bands = minhash_bands(openings.select("opening"))
    # links within a band run over its smallest opening, so a crowded band gives a star and not all pairs
    heads = bands.groupBy("band").agg(F.min("opening").alias("head"), F.max("opening").alias("other")).filter("head <> other").drop("other")
    links = bands.join(heads, "band").filter("opening <> head").select(F.col("head").alias("a"), F.col("opening").alias("b")).distinct()
    roots = components(links.filter(alike("a", "b")))
    placed = cut(openings.select("opening").join(roots.withColumnRenamed("node", "opening"), "opening", "left").select("opening", F.coalesce("root", "opening").alias("root")))
    # pairs that the stars leave in different clusters; a shingle met in one cluster only has none
    rare = cut(rare_shingles(placed, shingle_counters(placed)))
    mixed = rare.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("k")
    open_ = rare.join(mixed, "k")
    near = open_.alias("p").join(open_.alias("q"), "k").filter(f"p.root < q.root AND least(p.size, q.size) >= {SIMILARITY}D * greatest(p.size, q.size)")
    near = near.select(F.col("p.opening").alias("a"), F.col("q.opening").alias("b"), F.col("p.root").alias("ra"), F.col("q.root").alias("rb")).distinct()
    merged = components(near.filter(alike("a", "b")).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return placed.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("opening", F.coalesce("top", "root").alias("cluster"))


def refusal_openings(responses: DataFrame) -> DataFrame:
    """Openings of refusal templates. Answer rates count all responses of an opening, prompts those of responses without an answer.

    Responses that reach an answer only count, so hashes of their keys do, in ``seen`` where it is there;
    an opening that no response leaves without an answer is none.
    """
    r = responses.filter("NOT answered").select("prompt", F.explode("keys").alias("opening"))
    seen = F.col("seen") if "seen" in responses.columns else F.transform("keys", lambda k: F.xxhash64(k))
    sound = responses.filter("answered").select(F.explode(seen).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("answers"))
    counts = r.groupBy("opening").agg(F.count(F.lit(1)).alias("m")).withColumn("h", F.xxhash64("opening")).join(sound, "h", "left")
    counts = counts.select("opening", F.coalesce("answers", F.lit(0)).alias("answers"), (F.col("m") + F.coalesce("answers", F.lit(0))).alias("n"))
    open_ended = cut(counts)
    named = open_ended.join(clusters(open_ended), "opening")
    prompts = r.join(named.select("opening", "cluster"), "opening").groupBy("cluster").agg(F.countDistinct("prompt").alias("prompts"))
    rates = named.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("answers").alias("answers"))
    found = rates.join(prompts, "cluster").filter((F.col("prompts") >= PROMPTS) & (F.col("answers") <= ANSWERED * F.col("n")))
    return named.join(found.select("cluster"), "cluster").select("opening", F.lit(True).alias("template"))


def respond(r, model: E.Endings, languages: Languages, limits: dict[str, frozenset[int]]) -> list[tuple]:
    """(id, field, own defect, keys, their hashes if it reaches an answer, whether it does, prompt) of the responses of a record."""
    question, cores = words_of(r.question), E.option_cores(r.options)
    q_lang, lead = languages.guess(question)
    if lead < 3.0:
        q_lang = (r.question_lang or "").strip().lower()[:2] or None
    known, prompt = set(question), zlib.crc32(" ".join(question).encode())
    out = []
    for field in FIELDS:
        text = getattr(r, field)
        s = E.plain(text)
        w = words_of(s)
        state = E.short_answer(s, cores) if field == "answer_raw" or len(s) < 120 else None
        kind = E.closing_class(s, cores) if s else "none"
        defect = label(s, w, text or "", question, q_lang, cores, model, languages, kind, state, limits[field])
        looked = defect not in ("empty", "copies_question")
        keys, answered = keys_of(s, known) if looked else [], looked and reaches_answer(s, kind, state)
        out.append((r.id, field, defect, [] if answered else keys, [key_hash(k) for k in keys] if answered else [], answered, prompt))
    return out


def answer_defects(raw: DataFrame, id_col: str = "raw_id") -> DataFrame:
    """(id, answer_field, defect) of every response; ``defect`` is NULL for sound ones.

    A null question makes no copy and no foreign answer. Null options leave only the wording to go by.
    Repeated records are all labelled. Extra columns are ignored; an empty table gives no rows.
    """
    model = truncation_model(raw, "long_cot_raw", "options", id_col)
    limits = E.limits_of_fields(raw, {f: [F.col(f)] for f in FIELDS})
    rows = [r for r in E.bounded_sample(raw.select("question_lang", "question", "long_cot_raw", id_col), [id_col], LANGUAGE_ROWS).collect() if r.question_lang and r.question]
    languages = Languages([(r.question_lang.strip().lower()[:2], f"{r.question} {(r.long_cot_raw or '')[:300]}") for r in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [x for r in b.itertuples(index=False) for x in respond(r, model, languages, limits)]
            yield pd.DataFrame(out, columns=["id", "answer_field", "defect", "keys", "seen", "answered", "prompt"])

    seen = raw.select(F.col(id_col).cast("bigint").alias("id"), "question", "options", "question_lang", *FIELDS)
    labelled = cut(seen.mapInPandas(run, "id bigint, answer_field string, defect string, keys array<string>, seen array<bigint>, answered boolean, prompt bigint"))
    templates = refusal_openings(labelled)
    hits = labelled.filter("NOT answered").select("id", "answer_field", F.explode("keys").alias("opening")).join(templates, "opening")
    refused = hits.groupBy("id", "answer_field").agg(F.first("template").alias("refused"))
    joined = labelled.join(refused, ["id", "answer_field"], "left")
    return joined.select(F.col("id").alias(id_col), "answer_field", F.when(F.col("refused"), "refusal").otherwise(F.col("defect")).alias("defect"))
