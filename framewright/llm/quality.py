"""Per-document text quality statistics, and a robust distance from the prose of the document's language.

What is common in a language, and how its letters follow each other, is learnt from all labelled rows.
Prose has a mean and covariance per language, fitted on all documents by reweighting: start from texts
without list, table or junk parts, then keep those within a chi-square quantile. Each document gets its
squared Mahalanobis distance and what each statistic adds to it. The statistics that tell of a list, a
table or junk form three groups; an outlier is of the kind whose group adds most, if that group alone
takes it past the quantile. The spread of a share is at least such that half a text does so.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.textstats import _WORD, LETTERS, STATS, Wording, describe_all, distinct_shares, letter_pairs
from framewright.session import cut

#: Words a task counts before it hands its counts on.
WORDS_HELD = 200_000
#: A word is common if so large a share of the texts of a language hold it; a language needs so large a share of all.
COMMON_SHARE, LANGUAGE_SHARE = 0.25, 0.002
#: Texts that hold a word whose spelling is learnt: so many, and so large a share of all.
SPELLING_TEXTS, SPELLING_SHARE = 3, 3 / 8000
#: Texts of prose a language needs for a mean of its own; others go by all prose.
PROSE_TEXTS = 20


def chi_square(k: int, p: float) -> float:
    """Quantile of the chi-square distribution with ``k`` degrees of freedom (Wilson and Hilferty)."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


CUTOFF = chi_square(len(STATS), 0.999)
#: The share of a text, or value beyond that of prose, that by itself reaches the cutoff.
REACH = {"list_share": 0.5, "table_share": 0.5, "odd_ratio": 0.12, "coded_share": 0.5, "tag_share": 0.5, "repeat_share": 0.5, "menu_share": 0.5, "pair_fit": 0.75}
GROUPS = {"list": ["list_share"], "table": ["table_share"], "junk": ["odd_ratio", "coded_share", "tag_share", "repeat_share", "menu_share", "pair_fit"]}
SPREAD = {"log_words": 0.3, "word_length": 0.3, "symbol_ratio": 0.01, "line_end_share": 0.15, "common_share": 0.05, "digit_ratio": 0.02, "upper_ratio": 0.03, "distinct_share": 0.05}
SPREAD_FLOOR = np.array([SPREAD[s] if s in SPREAD else REACH[s] / CUTOFF**0.5 for s in STATS])


def distinct_share(words: list[str]) -> float:
    """Share of distinct words, averaged over all windows of consecutive words; of fewer words, their own."""
    seen: dict[str, int] = {}
    first = np.fromiter(map(seen.setdefault, words, range(len(words))), dtype=np.int64, count=len(words))
    return float(distinct_shares(first, np.zeros(len(words), np.int64), np.array([len(words)]))[0])


def describe(text: str | None, wording: Wording | None = None) -> tuple[str, int, list[float]] | None:
    """(language, words, statistics) of one text; None for null, empty and blank texts."""
    at, languages, words, stats = describe_all([text], wording or Wording({}, np.zeros((0, 3))))
    return (languages[0], int(words[0]), stats[0].tolist()) if len(at) else None


def slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text is a range of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def learn_wording(docs: DataFrame, text_col: str, lang_col: str | None) -> Wording:
    """Common words of each language and letter pairs of all, from all texts; only what is common reaches the driver.

    The label is the first two letters of ``lang_col`` in lower case; rows without one are left out while
    any row has one. Wrong labels do no harm while they are few. A language brings the words that at least
    COMMON_SHARE of its texts hold, so their number is bounded by the length of a text.
    """
    label = F.lower(F.substring(F.trim(F.col(lang_col)), 1, 2)) if lang_col else F.lit("any")
    rows = docs.select(F.col(text_col).alias("text"), label.alias("label")).filter(F.col("text").isNotNull())
    if lang_col:
        labelled = rows.filter("label IS NOT NULL AND label <> ''")
        rows = labelled if not labelled.isEmpty() else rows.withColumn("label", F.lit("any"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def counts() -> pd.DataFrame:
            out = pd.DataFrame([(lang, w, n) for lang, c in held.items() for w, n in c.items()], columns=["label", "word", "n"])
            held.clear()
            return out

        for b in batches:
            texts = b["text"].tolist()
            labels = b["label"].tolist()
            for a, z in slices(texts):
                for lang, t in zip(labels[a:z], texts[a:z], strict=True):
                    c = held.setdefault(lang, Counter())
                    c.update(set(_WORD.findall(t.lower())))
                    c[""] += 1
                if sum(map(len, held.values())) > WORDS_HELD:
                    yield counts()
        yield counts()

    met = cut(rows.mapInPandas(count, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n")))
    texts = {r.label: r.n for r in met.filter("word = ''").select("label", "n").collect()}
    known = {k: n for k, n in texts.items() if n >= max(PROSE_TEXTS, LANGUAGE_SHARE * sum(texts.values()))} or texts
    common: dict[str, list[str]] = {k: [] for k in known}
    if known:
        least = F.create_map(*[x for k, n in known.items() for x in (F.lit(k), F.lit(max(2.0, COMMON_SHARE * n)))])
        for r in met.filter((F.col("word") != "") & (F.col("n") >= F.try_element_at(least, F.col("label")))).select("label", "word").collect():
            common[r.label].append(r.word)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, x, y = letter_pairs(b["word"].tolist())
            pair, times = np.unique((x.astype(np.int64) << 32) | y, return_counts=True)
            yield pd.DataFrame({"x": pair >> 32, "y": pair & 0xFFFFFFFF, "n": times})

    # words of one text only, such as random letters, teach no spelling; of a word all texts count as one
    enough = max(SPELLING_TEXTS, SPELLING_SHARE * sum(texts.values()))
    words = met.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= enough).select("word")
    pairs = cut(words.mapInPandas(spell, "x bigint, y bigint, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n")))
    letters = pairs.groupBy("x").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "x").limit(LETTERS).select("x")
    kept = pairs.join(F.broadcast(letters), "x").join(F.broadcast(letters.withColumnRenamed("x", "y")), "y")
    return Wording(common, kept.select("x", "y", "n").toPandas().to_numpy(dtype=np.int64).reshape(-1, 3))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(id, language, n_words, stats) of every document that is not null, empty or blank.

    The language is the one whose common words fill most of the text, whatever its label; "other" if none do.
    """
    lang_col = lang_col if lang_col in docs.columns else None
    wording = docs.sparkSession.sparkContext.broadcast(learn_wording(docs, text_col, lang_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b[id_col].to_numpy(), b[text_col].tolist()
            for a, z in slices(texts):
                at, languages, words, stats = describe_all(texts[a:z], wording.value)
                yield pd.DataFrame({id_col: ids[a:z][at], "language": pd.Series(languages, dtype=object), "n_words": words, "stats": pd.Series(list(stats), dtype=object)})

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInPandas(run, f"{id_col} bigint, language string, n_words bigint, stats array<double>")


def _moments(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of each language and of the most frequent one ("*"), from sums over all rows; one row a language comes back."""
    k = len(STATS)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list] = {}
        for b in batches:
            x = np.array(b["stats"].tolist(), dtype=float).reshape(-1, k)
            for lang in set(b["language"]):
                y = x[(b["language"] == lang).to_numpy()]
                s = sums.setdefault(lang, [0, np.zeros(k), np.zeros((k, k))])
                s[0], s[1], s[2] = s[0] + len(y), s[1] + y.sum(axis=0), s[2] + y.T @ y
        for lang, (n, v, w) in sums.items():
            yield pd.DataFrame({"language": [lang], "n": [n], "v": [np.concatenate([v, w.ravel()])]})

    parts = stats.select("language", "stats").mapInPandas(add, "language string, n bigint, v array<double>").select("language", "n", F.posexplode("v").alias("at", "v"))
    found: dict[str, list] = {}
    for r in parts.groupBy("language", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        s = found.setdefault(r.language, [r.n, np.zeros(k + k * k)])
        s[1][r.at] = r.v
    if found:
        # texts of no language are judged by the prose of the language with most of it
        found["*"] = max((s for k, s in found.items() if k != "other"), key=lambda s: s[0], default=found.get("other"))
    out = {}
    for lang, (n, v) in found.items():
        if lang == "*" or (n >= PROSE_TEXTS and lang != "other"):
            mean = v[:k] / n
            cov = v[k:].reshape(k, k) / n - np.outer(mean, mean)
            out[lang] = (mean, cov * (n / (n + 5.0)) + np.diag(SPREAD_FLOOR**2))
    return out


def _distances(x: np.ndarray, languages: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, and the part of each statistic: (x - m) times the row of the inverse covariance."""
    parts = np.zeros_like(x)
    for lang in set(languages.tolist()):
        mean, inverse = model.get(lang, model["*"])
        at = languages == lang
        d = x[at] - mean
        parts[at] = d * (d @ inverse)
    return parts.sum(axis=1), parts


def kinds_of(parts: np.ndarray) -> list[str | None]:
    """The kind whose statistics add most to the distance, if what they add reaches the cutoff."""
    if not len(parts):
        return []
    names = list(GROUPS)
    by_group = np.stack([np.maximum(parts[:, [STATS.index(s) for s in GROUPS[g]]], 0.0).sum(axis=1) for g in names], axis=1)
    best = by_group.argmax(axis=1)
    return [names[j] if v > CUTOFF else None for j, v in zip(best.tolist(), by_group.max(axis=1).tolist(), strict=True)]


def _near(model: dict):
    """Whether a row lies within the cutoff of its language's prose."""

    @F.pandas_udf("boolean")
    def near(stats: pd.Series, language: pd.Series) -> pd.Series:
        d, _ = _distances(np.array(stats.tolist(), dtype=float).reshape(-1, len(STATS)), language.to_numpy(), model)
        return pd.Series(d <= CUTOFF)

    return near


def fit_prose(stats: DataFrame, rounds: int = 2) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and inverse covariance of prose per language ("*" for languages with little or no prose)."""
    k = len(STATS)
    odd = sum((F.get("stats", F.lit(STATS.index(s))) / REACH[s] for s in REACH if s != "pair_fit"), F.lit(0.0))
    kept, model = stats.filter((odd < 0.3) & (F.col("n_words") >= 20)), {}
    for _ in range(rounds):
        model = {lang: (m, np.linalg.inv(c)) for lang, (m, c) in _moments(kept).items()}
        model.setdefault("*", (np.zeros(k), np.diag(1 / SPREAD_FLOOR**2)))
        kept = stats.filter(_near(dict(model))("stats", "language"))
    return model


def document_kinds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(id, language, n_words, each statistic, distance2, part_* of each statistic, doc_kind).

    ``doc_kind`` is list, table, junk, or NULL for prose, also for prose far from that of its language.
    Null, empty and blank texts give no row; a text without words has statistics all the same. An empty
    table gives no rows. Without ``lang_col`` all texts are one language.
    """
    k = len(STATS)
    stats = cut(document_statistics(docs, id_col, text_col, lang_col))
    model = fit_prose(stats)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["stats"].tolist(), dtype=float).reshape(-1, k)
            d, parts = _distances(x, b["language"].to_numpy(), model)
            out = b[[id_col, "language", "n_words"]].copy()
            for i, name in enumerate(STATS):
                out[name] = x[:, i]
            out["distance2"] = d
            for i, name in enumerate(STATS):
                out[f"part_{name}"] = parts[:, i]
            out["doc_kind"] = pd.Series(kinds_of(parts), dtype=object, index=out.index)
            yield out

    names = ", ".join(f"{s} double" for s in STATS)
    parts = ", ".join(f"part_{s} double" for s in STATS)
    return stats.mapInPandas(judge, f"{id_col} bigint, language string, n_words bigint, {names}, distance2 double, {parts}, doc_kind string")
