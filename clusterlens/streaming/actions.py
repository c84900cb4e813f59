"""User actions on windows: registered by name, each run as its own streaming query."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clusterlens.streaming.queries import start

Action = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class ActionInfo:
    """Where an action lives and how often it runs."""

    module: str
    function: str
    interval_ms: int


def parse(text: str) -> list[ActionInfo]:
    """Actions of a list `module:function:interval,...`; incomplete entries are skipped."""
    found = []
    for entry in text.split(","):
        parts = [p.strip() for p in entry.split(":")]
        if len(parts) >= 3 and all(p.isidentifier() for p in parts[0].split(".")):
            found.append(ActionInfo(parts[0], parts[1], int(parts[2])))
    return found


def resolve(info: ActionInfo) -> Action:
    return getattr(importlib.import_module(info.module), info.function)


class Registry:
    """Running actions. The first registration of a name wins; every action sees all windows.

    `windows` is a stream; give one over a stored table of windows, so that it is not parsed anew for each action. A
    `drained` registry starts its actions in `drain`, where each sees what is there and stops.
    """

    def __init__(self, windows: DataFrame, checkpoints: str | None = None, drained: bool = False):
        self.windows = windows
        self.checkpoints = checkpoints
        self.drained = drained
        self.running: dict[str, StreamingQuery] = {}
        self.waiting: dict[str, Action] = {}

    def register(self, name: str, action: Action, interval_ms: int | None = 1000) -> StreamingQuery | None:
        """Start an action; `interval_ms=None` lets it see what is there and stop."""
        if self.drained:
            self.waiting.setdefault(name, action)
            return None
        if name not in self.running:
            trigger = None if interval_ms is None else f"{interval_ms} milliseconds"
            self.running[name] = start(self.windows, action, name, self.checkpoints, trigger)
        return self.running[name]

    def load(self, text: str) -> None:
        for info in parse(text):
            self.register(f"{info.module}.{info.function}", resolve(info), info.interval_ms)

    def drain(self, seconds: int = 600) -> None:
        """Let all waiting actions see what is there."""
        for name, action in self.waiting.items():
            query = start(self.windows, action, name, self.checkpoints, None)
            if not query.awaitTermination(seconds):
                raise TimeoutError(f"action {name} did not end")

    def unregister(self, name: str) -> None:
        self.waiting.pop(name, None)
        query = self.running.pop(name, None)
        if query is not None:
            query.stop()
