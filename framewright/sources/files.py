"""Catalogues of files, and the choice among input layouts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.paths import base_name, suffix

# Suffixes of clips and of frames.
VIDEO_SUFFIXES = [".mp4", ".mkv", ".webm", ".mov", ".avi"]
FRAME_SUFFIXES = [".jpg", ".jpeg", ".png"]


def list_files(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """(name, path, suffix, length) of all files below ``root`` with one of the suffixes; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return found.select(base_name(F.col("path")).alias("name"), "path", suffix(F.col("path")).alias("suffix"), "length").filter(F.col("suffix").isin(*suffixes))


def frame_lists(files: DataFrame, suffixes: Sequence[str] = tuple(FRAME_SUFFIXES)) -> DataFrame:
    """(directory, frames): distinct paths of the frames of each directory in path order; empty where it holds other files only."""
    frame = F.when(suffix(F.col("path")).isin(*suffixes), F.col("path"))
    held = files.filter(F.contains("path", F.lit("/")))
    return held.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("directory")).agg(F.array_sort(F.collect_set(frame)).alias("frames"))


def pick_layout(exists: Callable[[str], bool], root: str, single: str | None = None) -> dict[str, str]:
    """Split name to file: one named file, a train/test pair, or the older pair of names."""
    if single:
        return {"data": single}
    for a, b in (("train.jsonl", "test.jsonl"), ("train_80.jsonl", "test_20.jsonl")):
        if exists(f"{root}/{a}") and exists(f"{root}/{b}"):
            return {"train": f"{root}/{a}", "test": f"{root}/{b}"}
    raise FileNotFoundError(f"no input files below {root}")


def retry_waits(attempts: int, sleep: float) -> list[float]:
    """Seconds to wait after each failed attempt: a linear back-off, none after the last."""
    if attempts < 1:
        raise ValueError("one attempt is needed at least")
    return [sleep * k for k in range(1, attempts)]
