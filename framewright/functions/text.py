"""Column builders for tagged completions, choice letters, prompts and answers. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.paths import trim_ws

# Tag dialects and formats of the annotation and completion texts.
ANSWER_TAG = r"(?is)<ANSWER[S]?>(.*?)</ANSWER[S]?>"
TOLERANT_ANSWER_TAG = r"(?is)<\s*answers?\s*>(.*?)<\s*/\s*answers?\s*>"
COT_TAG = r"(?s)<COT>(.*?)</COT>"
LONG_COT_TAG = r"(?s)<LONG_COT>(.*?)</LONG_COT>"
ANY_ANSWER_TAG = r"(?i)<ANSWER[S]?>|</ANSWER[S]?>"
STRICT_FORMATS = [
    r"\s*<ANSWER[S]?>.*?</ANSWER[S]?>\s*",
    r"\s*<COT>.*?</COT>\s*<ANSWER[S]?>.*?</ANSWER[S]?>\s*",
    r"\s*<LONG_COT>.*?</LONG_COT>\s*<ANSWER[S]?>.*?</ANSWER[S]?>\s*",
]
PERSPECTIVE_TAGS = (["REASONING_TYPE", "GRANULARITY_TYPE", "PERSPECTIVE"], ["REASONING", "THINKING"], ["ANSWER"])
IMAGE_PLACEHOLDER = r"<image\s*\d*>\s*"

STRICT_FORMAT = r"(?s)\A(?:" + "|".join(STRICT_FORMATS) + r")\z"
LETTER_RANGES = ("A-G", "A-E", "A-J")


def blank_to_null(c: Column) -> Column:
    """NULL for a string that is empty or only white space, else the stripped string."""
    return F.nullif(trim_ws(c), F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    """The first value that is neither NULL nor the empty string; blanks count as values."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_nonblank(*cols: Column) -> Column:
    """The first value that is not blank, stripped."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def normalize_space(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim_ws(c)), r"(?U)\s+", " ")


def extract_answer(c: Column) -> Column:
    """Text in the first answer tag, any letter case; the whole text where there is none. NULL counts as empty."""
    t = F.coalesce(c, F.lit(""))
    return trim_ws(F.when(t.rlike(ANSWER_TAG), F.regexp_extract(t, ANSWER_TAG, 1)).otherwise(t))


def choice_letter(c: Column, letters: str = "A-G") -> Column:
    """A letter that stands alone, else the first letter of the range anywhere, else the normalised text (lower case)."""
    return letter_of(extract_answer(c), letters)


def letter_of(a: Column, letters: str = "A-G") -> Column:
    """The letter of an answer that is out of its tag."""
    alone = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])([{letters}])(?:$|[^\p{{L}}\p{{N}}_])"
    anywhere = rf"(?i)([{letters}])"
    return F.when(a.rlike(alone), F.lower(F.regexp_extract(a, alone, 1))).when(a.rlike(anywhere), F.lower(F.regexp_extract(a, anywhere, 1))).otherwise(normalize_space(a))


def reasoning_type(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.when(t.rlike(COT_TAG), "cot_tag").when(t.rlike(LONG_COT_TAG), "long_cot_tag").otherwise("none")


def reasoning_text(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.when(t.rlike(COT_TAG), trim_ws(F.regexp_extract(t, COT_TAG, 1))).when(t.rlike(LONG_COT_TAG), trim_ws(F.regexp_extract(t, LONG_COT_TAG, 1))).otherwise("")


def format_ok(c: Column) -> Column:
    """1 where the whole text is one of the three allowed tag layouts, case-sensitive; else 0."""
    return F.coalesce(c, F.lit("")).rlike(STRICT_FORMAT).cast("int")


def n_chars(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))).cast("bigint")


def n_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), F.lit(0))).cast("bigint")


def format_class(c: Column) -> Column:
    """Six ordered classes of how an answer is laid out; ``tagged_non_strict`` cannot occur, as any tag is met before."""
    t = F.coalesce(c, F.lit(""))
    return (
        F.when(t.rlike(r"(?is)\A\s*<ANSWER[S]?>\s*[A-G]\s*</ANSWER[S]?>\s*\z"), "strict_tag_letter")
        .when(t.rlike(ANY_ANSWER_TAG), "broken_or_partial_tag")
        .when(format_ok(t) == 1, "tagged_non_strict")
        .when(t.rlike(r"(?i)\A\s*[A-G]\."), "plain_option_sentence")
        .when(t.rlike(r"(?i)\A\s*[A-G]\s*\z"), "plain_letter")
        .otherwise("other")
    )


def tag_block(c: Column, tag: str) -> Column:
    """The first block of ``tag`` with its tags, case-sensitive; NULL if there is none."""
    p = rf"(?s)(<{tag}>\s*.*?\s*</{tag}>)"
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))


def first_tag_block(c: Column, tags: list[str]) -> Column:
    return F.coalesce(*[tag_block(c, t) for t in tags])


def has_code_block(c: Column) -> Column:
    return tag_block(c, "CODE").isNotNull()


def wrap_answer(c: Column) -> Column:
    """Answer text, out of a loosely written tag if there is one, in canonical tags."""
    t = F.coalesce(c, F.lit(""))
    inner = F.when(t.rlike(TOLERANT_ANSWER_TAG), F.regexp_extract(t, TOLERANT_ANSWER_TAG, 1)).otherwise(t)
    return F.concat(F.lit("<ANSWER>"), trim_ws(inner), F.lit("</ANSWER>"))


def plain_answer(c: Column) -> Column:
    """Text after the first exact ``<answer>`` up to the next close tag (any case), else the stripped text.

    NULL where a close tag occurs but only before the open tag: such a row is malformed.
    """
    t = trim_ws(F.coalesce(c, F.lit("")))
    low = F.lower(t)
    start = F.locate("<answer>", low)
    rest = F.substr(low, start + 8)
    size = F.instr(rest, F.lit("</answer>")) - 1
    return F.when((start == 0) | ~F.contains(low, F.lit("</answer>")), t).when(size >= 0, trim_ws(F.substr(t, start + 8, size)))


def option_list(c: Column) -> Column:
    """Options of an array column: stripped, blanks dropped; NULL gives an empty array."""
    return F.coalesce(F.filter(F.transform(c, lambda o: trim_ws(o)), lambda x: x != ""), F.array().cast("array<string>"))


def option_lines(c: Column) -> Column:
    """Options of a string column, one per line."""
    return option_list(F.split(c, r"\r\n|\n|\r"))


def option_map(c: Column) -> Column:
    """Options of a letter map as sorted ``K. text``, blanks dropped."""
    entries = F.array_sort(F.map_entries(c))
    kept = F.filter(entries, lambda e: trim_ws(F.coalesce(e["value"], F.lit(""))) != "")
    return F.transform(kept, lambda e: F.concat(e["key"], F.lit(". "), trim_ws(e["value"])))


def problem_text(problem: Column, question: Column, options: Column) -> Column:
    """Question with its label, and the options below unless the text holds all of them already.

    ``problem`` hides ``question`` unless NULL or empty, also where it is only blanks; the pick is stripped afterwards.
    """
    base = trim_ws(F.coalesce(F.nullif(problem, F.lit("")), F.nullif(question, F.lit("")), F.lit("")))
    opts = option_list(options)
    labelled = F.when(base == "", F.lit("")).when(F.lower(base).startswith("question:"), base).otherwise(F.concat(F.lit("Question: "), base))
    held = F.forall(opts, lambda o: F.contains(base, o))
    head = F.when(base == "", F.lit("Question:")).otherwise(labelled)
    return F.when((F.size(opts) == 0) | held, labelled).otherwise(F.concat(head, F.lit("\nOptions:\n"), F.array_join(opts, "\n")))


def question_with_options(question: Column, options: Column) -> Column:
    q, opts = trim_ws(F.coalesce(question, F.lit(""))), option_list(options)
    return F.when(F.size(opts) == 0, q).otherwise(F.concat(q, F.lit("\n\nOptions:\n"), F.array_join(opts, "\n")))


def user_text(instruction: Column, extra: Column, format_note: Column) -> Column:
    """Parts joined by blank lines; blank parts after the instruction are left out."""
    return F.concat_ws("\n\n", trim_ws(F.coalesce(instruction, F.lit(""))), blank_to_null(extra), blank_to_null(format_note))


def strip_image_marks(c: Column) -> Column:
    return trim_ws(F.regexp_replace(F.coalesce(c, F.lit("")), IMAGE_PLACEHOLDER, ""))


def perspective_target(c: Column) -> Column:
    """Type, reasoning and answer blocks in order, each under any of its tag names; NULL if one is missing."""
    kind, reasoning, answer = (first_tag_block(c, tags) for tags in PERSPECTIVE_TAGS)
    return F.concat(kind, F.lit("\n"), reasoning, F.lit("\n"), answer)
