"""Configuration records: a YAML or JSON mapping into a typed record with defaults."""

from __future__ import annotations

import dataclasses
import json
from typing import Any


@dataclasses.dataclass
class RunConfig:
    """Settings of a run; ``merge_output_dir`` follows ``output_dir`` where it is not given."""

    output_dir: str = "out"
    sft_mode: str = "length"
    merge_output_dir: str | None = None
    reasoning_formats: list[str] = dataclasses.field(default_factory=lambda: ["answer", "cot", "long_cot"])
    drop_code_cot: bool = True
    validation_ratio: float = 0.05
    seed: int = 42

    def __post_init__(self) -> None:
        self.sft_mode = str(self.sft_mode).strip().lower()
        if self.sft_mode not in ("length", "perspective"):
            raise ValueError(f"unknown sft_mode: {self.sft_mode}")
        if not 0 <= self.validation_ratio < 1:
            raise ValueError("validation_ratio must lie in [0, 1)")
        if self.merge_output_dir is None:
            self.merge_output_dir = f"{self.output_dir}_merged"


def parse_config(text: str, record: type = RunConfig) -> Any:
    """The record of a mapping in JSON, or in YAML where a YAML reader is installed; unknown keys are an error."""
    try:
        values = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the text is no JSON, and no YAML reader is installed") from e
        values = yaml.safe_load(text)
    if not isinstance(values, dict):
        raise ValueError("a configuration is a mapping")
    unknown = set(values) - {f.name for f in dataclasses.fields(record)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return record(**values)
