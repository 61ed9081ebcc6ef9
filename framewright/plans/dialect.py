"""SQL fragments in the dialect of the checking engine, mirroring the Column builders."""

from __future__ import annotations

from framewright.functions import text as T

WS = r"[\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def blank_to_null(x: str) -> str:
    return f"nullif({trim_ws(x)}, '')"


def norm_space(x: str) -> str:
    return f"regexp_replace(lower({trim_ws(x)}), {q(WS + '+')}, ' ', 'g')"


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def extract_answer(x: str) -> str:
    t = f"coalesce({x}, '')"
    return trim_ws(f"(CASE WHEN {matches(t, T.ANSWER_TAG)} THEN {extract(t, T.ANSWER_TAG)} ELSE {t} END)")


def choice_letter(x: str, letters: str = "A-G") -> str:
    a = extract_answer(x)
    alone = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])([{letters}])(?:$|[^\p{{L}}\p{{N}}_])"
    anywhere = rf"(?i)([{letters}])"
    return f"(SELECT CASE WHEN {matches('z', alone)} THEN lower({extract('z', alone)}) WHEN {matches('z', anywhere)} THEN lower({extract('z', anywhere)}) ELSE {norm_space('z')} END FROM (SELECT {a} AS z))"


def reasoning_type(x: str) -> str:
    t = f"coalesce({x}, '')"
    return f"(CASE WHEN {matches(t, T.COT_TAG)} THEN 'cot_tag' WHEN {matches(t, T.LONG_COT_TAG)} THEN 'long_cot_tag' ELSE 'none' END)"


def reasoning_text(x: str) -> str:
    t = f"coalesce({x}, '')"
    return f"(CASE WHEN {matches(t, T.COT_TAG)} THEN {trim_ws(extract(t, T.COT_TAG))} WHEN {matches(t, T.LONG_COT_TAG)} THEN {trim_ws(extract(t, T.LONG_COT_TAG))} ELSE '' END)"


def format_ok(x: str) -> str:
    return f"CAST({matches(f'coalesce({x}, {chr(39) * 2})', T.STRICT_FORMAT)} AS INT)"


def format_class(x: str) -> str:
    t = f"coalesce({x}, '')"
    return (
        f"(CASE WHEN {matches(t, chr(40) + '?is)' + chr(92) + 'A' + chr(92) + 's*<ANSWER[S]?>' + chr(92) + 's*[A-G]' + chr(92) + 's*</ANSWER[S]?>' + chr(92) + 's*' + chr(92) + 'z')} THEN 'strict_tag_letter'"
        f" WHEN {matches(t, T.ANY_ANSWER_TAG)} THEN 'broken_or_partial_tag'"
        f" WHEN {format_ok(x)} = 1 THEN 'tagged_non_strict'"
        rf" WHEN {matches(t, '(?i)^' + chr(92) + 's*[A-G][.]')} THEN 'plain_option_sentence'"
        rf" WHEN {matches(t, '(?i)^' + chr(92) + 's*[A-G]' + chr(92) + 's*$')} THEN 'plain_letter' ELSE 'other' END)"
    )


def n_words(x: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), {q(chr(92) + 'S+')})) AS BIGINT)"


def n_chars(x: str) -> str:
    return f"CAST(length(coalesce({x}, '')) AS BIGINT)"


def safe_stem(x: str, default: str = "sample") -> str:
    kept = f"regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g')"
    return f"coalesce(nullif(trim({kept}, '_'), ''), '{default}')"


def parts(x: str) -> str:
    return f"list_filter(string_split(coalesce({x}, ''), '/'), lambda p: p NOT IN ('', '.', '..'))"


def drop_suffix(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '([^/])\\.[^./]+$', '\\1')"


def options(x: str) -> str:
    return f"coalesce(list_filter(list_transform({x}, lambda o: {trim_ws('o')}), lambda o: o <> ''), CAST([] AS VARCHAR[]))"


def with_options(question: str, opts: str) -> str:
    return f"(CASE WHEN len({options(opts)}) = 0 THEN {trim_ws(f'coalesce({question}, {chr(39) * 2})')} ELSE {trim_ws(f'coalesce({question}, {chr(39) * 2})')} || chr(10) || chr(10) || 'Options:' || chr(10) || array_to_string({options(opts)}, chr(10)) END)"


def plain_answer(x: str) -> str:
    t = trim_ws(f"coalesce({x}, '')")
    rest = f"substr(lower({t}), strpos(lower({t}), '<answer>') + 8)"
    cut = f"substr({t}, strpos(lower({t}), '<answer>') + 8, strpos({rest}, '</answer>') - 1)"
    return f"(CASE WHEN strpos(lower({t}), '<answer>') = 0 OR strpos(lower({t}), '</answer>') = 0 THEN {t} WHEN strpos({rest}, '</answer>') > 0 THEN {trim_ws(cut)} END)"


def tag_block(x: str, tag: str) -> str:
    return f"nullif(regexp_extract(coalesce({x}, ''), '(?s)(<{tag}>\\s*.*?\\s*</{tag}>)', 1), '')"


def has_media(frames: str, image: str, path: str) -> str:
    return f"(coalesce(len(list_filter({frames}, lambda f: f IS NOT NULL AND f <> '')), 0) > 0 OR coalesce({image}, '') <> '' OR coalesce({path}, '') <> '')"
