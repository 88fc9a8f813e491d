"""Stages of a fit: events to a callback, lines and a heartbeat to stderr, job descriptions to Spark's pages."""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

HEARTBEAT_SECONDS = 5.0


@dataclass(frozen=True)
class ProgressEvent:
    stage: str
    completed: int | None
    total: int | None
    elapsed_seconds: float
    message: str


class Reporter:
    def __init__(self, shown: bool, callback: Callable[[ProgressEvent], None] | None, heartbeat: float = HEARTBEAT_SECONDS):
        self.shown, self.callback, self.heartbeat = shown, callback, heartbeat
        self.began, self.stage, self._over = time.monotonic(), "", threading.Event()
        self.context = None

    def elapsed(self) -> float:
        return time.monotonic() - self.began

    def _say(self, text: str) -> None:
        print(f"impulsar: {text} ({self.elapsed():.1f}s)", file=sys.stderr, flush=True)

    def _beat(self) -> None:
        while not self._over.wait(self.heartbeat):
            self._say(f"{self.stage} ...")

    def __enter__(self) -> Reporter:
        if self.shown:
            threading.Thread(target=self._beat, daemon=True).start()
        return self

    def __exit__(self, kind, value, trace) -> None:
        self._over.set()
        if self.context is not None:
            self.context.setJobDescription(None)
        if self.shown:
            self._say("fit failed" if kind else "fit complete")

    def update(self, stage: str, completed: int | None = None, total: int | None = None, message: str = "") -> None:
        self.stage = stage
        if self.context is not None:
            self.context.setJobDescription(f"impulsar: {stage}")
        if self.shown:
            part = f" {completed}/{total}" if total is not None else ""
            self._say(f"{stage}{part}{': ' + message if message else ''}")
        if self.callback is not None:
            self.callback(ProgressEvent(stage, completed, total, self.elapsed(), message))
