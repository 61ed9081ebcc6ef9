"""Seam for decoding: pixels and models stay outside; a decoder or scorer plugs in by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Decoder = Callable[[str, list[int]], list[str]]
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def decode_frames(clips: DataFrame, decoder: Decoder) -> DataFrame:
    """(path, frames, status) of clips (path, indices). A clip that fails gets an empty list and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            frames, status = [], []
            for path, indices in zip(b["path"], b["indices"], strict=True):
                try:
                    frames.append(decoder(path, list(indices)))
                    status.append("ok")
                except Exception as e:  # one broken clip must not end the job
                    frames.append([])
                    status.append(f"{type(e).__name__}: {e}"[:200])
            yield pd.DataFrame({"path": b["path"], "frames": frames, "status": status})

    return clips.select("path", "indices").mapInPandas(run, "path string, frames array<string>, status string")


def score_with(df: DataFrame, prompt: str, completion: str, scorer: Scorer, name: str = "reward_model") -> DataFrame:
    """Add scores of an outside model, called once per Arrow batch."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: scorer(b[prompt], b[completion]).astype(float)})

    return df.mapInPandas(run, schema)
