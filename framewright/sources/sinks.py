"""JSON sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.scoring import LENGTHS


def write_jsonl(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines in UTF-8, overwriting; NULL fields are written. One file only where asked, for small results."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One pass, one directory per split."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(split).json(path)


def write_summary(df: DataFrame, path: str) -> dict:
    """A table of one row as an indented JSON file on the driver."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has exactly one row")
    out = rows[0].asDict(recursive=True)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    return out


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, after making sure that it is not empty."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def allowed_keys(column: str, allowed: list[str]):
    """A map column with only the allowed keys."""
    return F.map_filter(column, lambda k, v: k.isin(allowed))


def prediction_columns(scored: DataFrame, training: bool = False) -> DataFrame:
    """Columns of the prediction files, the short layout for training runs."""
    about = ["video_id", "question_id", "question_category", "problem", *(["problem_cleaned"] if "problem_cleaned" in scored.columns else []), "pred_raw"]
    graded = ["pred_answer", "gt_answer", "correct", "format_ok"]
    if training:
        return scored.select(*about, *graded)
    kinds = [F.col("reasoning_kind").alias("detected_reasoning_type"), F.col("reasoning_body").alias("reasoning_text")]
    return scored.select(*about, *kinds, *graded, *[c for c in LENGTHS if c in scored.columns])


def write_report(summary: DataFrame, predictions: DataFrame, path: str) -> None:
    """The summary as an indented JSON file and the predictions as JSON lines below one directory; predictions never reach the driver."""
    write_summary(summary, f"{path}/metrics.json")
    write_jsonl(predictions, f"{path}/results")
