"""Detection of truncated records, and how often each source truncates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.paths import trim_ws
from framewright.llm import endings as E

_OPEN = re.compile(r"<([A-Z_]{2,20})>")
_TAG = re.compile(r"<(/?)([A-Za-z_]{2,20})>")
_PART_TAG = re.compile(r"<[/A-Z_]{0,20}$")


def output_cut(model: E.Endings, output: str | None, instruction: str | None, depth: str | None, limits: frozenset[int] = frozenset()) -> bool:
    """Whether an exported output, or the reasoning or answer in it, stops early."""
    return output_score(model, output, instruction, depth, limits) > 0.5


def output_score(model: E.Endings, output: str | None, instruction: str | None, depth: str | None, limits: frozenset[int] = frozenset()) -> float:
    """Probability that an exported output is cut: the largest of its pieces'; 1 for open or broken tags and a begun option.

    ``limits`` are those of the whole output; a piece inside tags is held against the limits of the raw field.
    """
    if not output or not output.strip():
        return 0.0
    cores = E.options_of_prompt(instruction)
    text = output.rstrip()
    if _PART_TAG.search(text):
        return 1.0
    opened: list[str] = []
    pieces: list[tuple[str, str]] = []
    last = 0
    for m in _TAG.finditer(text):
        inner = text[last : m.start()]
        if inner.strip():
            pieces.append((opened[-1] if opened else "", inner))
        last = m.end()
        if not m.group(1):
            opened.append(m.group(2).upper())
        elif m.group(2).upper() in opened:
            while opened.pop() != m.group(2).upper():
                pass
    tags = {m.group(2).upper() for m in _TAG.finditer(text)}
    if opened or (tags and "ANSWER" not in tags):
        return 1.0
    if not tags:
        return _untagged_score(model, text, len(output), cores, depth, limits)
    scores = [_piece_score(model, inner, cores, tag == "ANSWER", len(inner.strip("\r\n")), model.limits) for tag, inner in pieces if not tag.endswith("TYPE")]
    tail = text[last:]
    if tail.strip():
        scores.append(_piece_score(model, tail, cores, False, len(output), limits))
    return max(scores, default=0.0)


def _piece_score(model: E.Endings, inner: str, cores: list[str], short: bool, length: int, limits: frozenset[int]) -> float:
    s = E.plain(inner)
    if not s:
        return 0.0
    if short or len(s) < 120:
        state = E.short_answer(s, cores)
        if state is not None:
            return 1.0 if state == "cut" else 0.0
    return model.score(s, cores, length, limits=limits)


def _untagged_score(model: E.Endings, text: str, length: int, cores: list[str], depth: str | None, limits: frozenset[int]) -> float:
    """Sources without tags write the reasoning, a blank line and the answer."""
    parts = text.rsplit("\n\n", 1)
    reasoning = 0.0
    if depth in ("COT", "LONG_COT") and len(parts) == 2:
        s = E.plain(parts[0])
        if len(s) >= 40:
            reasoning = model.score(s, cores, len(parts[0]))
        text = parts[1]
    return max(reasoning, _piece_score(model, text, cores, True, length, limits))


def trace_cut(model: E.Endings, text: str | None, cores: list[str]) -> bool:
    """Whether a reasoning text ends in mid-word or mid-sentence."""
    return trace_score(model, text, cores) > 0.5


def trace_score(model: E.Endings, text: str | None, cores: list[str]) -> float:
    """Probability that a reasoning text is cut; 0 for nothing and for fillers."""
    s = E.plain(text)
    if not s:
        return 0.0
    if len(s) < 120:
        state = E.short_answer(s, cores)
        if state is not None:
            return 1.0 if state == "cut" else 0.0
        if not re.search(r"[^\W_]{2}", s) or re.fullmatch(r"\W*(?:none|null|n/?a|nil)\W*", s, re.I):
            return 0.0
    return model.score(s, cores, len(text or ""))


def truncation_model(raw: DataFrame, text: str = "long_cot_raw", options: str = "options", id_col: str = "raw_id") -> E.Endings:
    limits = E.field_limits(raw, [F.col(text)])
    return E.fit_endings(E.sampled_texts(raw, text, options, [id_col]), limits)


def truncated_records(raw: DataFrame, export: DataFrame) -> DataFrame:
    """(table_name, rec_id, source_key, score, is_cut) of every row of both tables: the probability that its text is cut, and whether it is over a half.

    Null, empty and blank texts are not cut. Rows of a null source count under a NULL ``source_key``.
    Double rows are all scored. Without any intact text to learn from nothing is called cut by wording,
    while broken tags and begun options still are.
    """
    model = truncation_model(raw)
    limits = E.field_limits(export, [F.col("output")])

    def run_raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = [trace_score(model, t, E.option_cores(o)) for t, o in zip(b["text"], b["options"], strict=True)]
            yield pd.DataFrame({"table_name": "sft_raw", "rec_id": b["rec_id"], "source_key": b["source_key"], "score": scores})

    def run_export(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = [output_score(model, o, i, d, limits) for o, i, d in zip(b["output"], b["instruction"], b["reasoning_depth"], strict=True)]
            yield pd.DataFrame({"table_name": "sft_export", "rec_id": b["rec_id"], "source_key": b["source_key"], "score": scores})

    schema = "table_name string, rec_id bigint, source_key string, score double"
    key = F.lower(trim_ws(F.col("source_subset"))).alias("source_key")
    a = raw.select(F.col("raw_id").alias("rec_id"), key, F.col("long_cot_raw").alias("text"), "options").mapInPandas(run_raw, schema)
    b = export.select(F.col("export_id").alias("rec_id"), key, "output", "instruction", "reasoning_depth").mapInPandas(run_export, schema)
    return a.unionByName(b).withColumn("is_cut", F.col("score") > 0.5)
