"""Measuring and logging: timers, counts taken while a plan runs, and hiding secrets."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.sources.paths import pretty_seconds

_SECRET = re.compile(r"(?i)\b([\w-]*(?:secret|password|passwd|token|access_key|credential)[\w-]*)(\s*[=:]\s*)([^\s,;&]+)")


@dataclass
class Timer:
    """Seconds between start and stop; a context manager."""

    start: float = field(default_factory=time.perf_counter)
    end: float | None = None

    def __enter__(self) -> Timer:
        self.start, self.end = time.perf_counter(), None
        return self

    def __exit__(self, *_) -> None:
        self.end = time.perf_counter()

    @property
    def seconds(self) -> float:
        return (self.end if self.end is not None else time.perf_counter()) - self.start

    def __str__(self) -> str:
        return pretty_seconds(self.seconds)


def observed(df: DataFrame, name: str = "tiles") -> tuple[DataFrame, Observation]:
    """``df`` and what is counted of it as it is written: rows, tiles' lowest and highest zoom. No pass of its own."""
    o = Observation(name)
    cols = [F.count(F.lit(1)).alias("rows")]
    if "zoom" in df.columns:
        cols += [F.min("zoom").alias("min_zoom"), F.max("zoom").alias("max_zoom")]
    return df.observe(o, *cols), o


def redacted(text: str) -> str:
    """``text`` with the values of what looks like secrets replaced."""
    return _SECRET.sub(r"\1\2***", text)
