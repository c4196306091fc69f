"""Job settings from a YAML file and command-line arguments; arguments win."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class JobConfig:
    """A program's input, windows and thresholds; times in seconds."""

    input: str = ""
    host: str = "localhost"
    port: int = 9092
    topic: str = ""
    group: str = ""
    partitions: int = 4
    window: int = 3600
    slide: int = 300
    out_of_order: int = 2
    allowed_lateness: int = 30
    top: int = 5
    checkpoint: str = ""
    extra: dict = field(default_factory=dict)

    @property
    def watermark(self) -> str:
        """Spark has one knob for disorder and allowed lateness."""
        return f"{self.out_of_order + self.allowed_lateness} seconds"


def load(path: str, section: str | None = None) -> JobConfig:
    import yaml

    data = yaml.safe_load(Path(path).read_text()) or {}
    shared = {k: v for k, v in data.items() if not isinstance(v, dict)}
    if section and section not in data:
        raise KeyError(f"no section {section} in {path}")
    data = shared | (data[section] if section else {})
    known = {f.name for f in fields(JobConfig)} - {"extra"}
    return JobConfig(**{k: v for k, v in data.items() if k in known}, extra={k: v for k, v in data.items() if k not in known})


def from_args(argv: list[str]) -> JobConfig:
    parser = argparse.ArgumentParser(description="Run a streaming job")
    parser.add_argument("--config")
    parser.add_argument("--section")
    for f in fields(JobConfig):
        if f.name != "extra":
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=None)
    given = vars(parser.parse_args(argv))
    base = load(given.pop("config"), given.pop("section")) if given["config"] else JobConfig()
    return replace(base, **{k: v for k, v in given.items() if v is not None and k not in ("config", "section")})
