"""Request options, checked once on the driver before a job is planned."""

from __future__ import annotations

import math
from dataclasses import dataclass


class UsageError(ValueError):
    """Options that can't go together, or a value out of range (exit code 2)."""


@dataclass(frozen=True)
class Request:
    """What a recognition run is asked to do."""

    inputs: tuple[str, ...]
    model: str = "stub"
    task: str | None = None
    pages: str | None = None
    split_spreads: bool = False
    multi_page: bool = False
    figures: bool = False
    max_length: int = 8192
    ngram: int = 35
    ngram_window: int = 128
    temperature: float = 0.0

    def check(self, families: dict[str, set[str]] | None = None) -> Request:
        """Raises the first problem; returns itself. ``families``: the models that know each task."""
        if not self.inputs:
            raise UsageError("no input")
        pdf = all(i.lower().endswith(".pdf") for i in self.inputs)
        for flag, on in (("pages", self.pages), ("split_spreads", self.split_spreads), ("multi_page", self.multi_page)):
            if on and not pdf:
                raise UsageError(f"{flag} needs PDF input")
        if self.multi_page and (self.split_spreads or self.figures):
            raise UsageError("multi_page goes with neither split_spreads nor figures")
        if self.task and self.model not in (families or {}).get(self.task, set()):
            raise UsageError(f"model {self.model} doesn't know task {self.task}")
        for name, value, low in (("max_length", self.max_length, 1), ("ngram", self.ngram, 0), ("ngram_window", self.ngram_window, 0)):
            if value < low:
                raise UsageError(f"{name} is at least {low}")
        if not math.isfinite(self.temperature) or self.temperature < 0:
            raise UsageError("temperature is a finite number from 0 on")
        return self
