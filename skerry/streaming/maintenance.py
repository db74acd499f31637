"""Periodic refresh, flush, merge and retention of a store's indexes."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, fields

from ..sources.store import Store


@dataclass
class Intervals:
    """Seconds between the runs of each task; 0 means the default."""

    refresh: float = 1.0
    flush: float = 30.0
    merge: float = 60.0
    retention: float = 60.0

    def __post_init__(self) -> None:
        for f in fields(self):
            if not getattr(self, f.name):
                setattr(self, f.name, f.default)

    @staticmethod
    def from_environment() -> "Intervals":
        """SKERRY_REFRESH_SECS, SKERRY_FLUSH_SECS, SKERRY_MERGE_SECS and SKERRY_RETENTION_SECS, where set."""
        given = {f.name: os.environ.get(f"SKERRY_{f.name.upper()}_SECS") for f in fields(Intervals)}
        return Intervals(**{k: float(v) for k, v in given.items() if v})


class Maintenance:
    """Runs what is due for every index. An index that fails is left for the next turn, and the others go on."""

    def __init__(self, store: Store, intervals: Intervals | None = None, clock: Callable[[], float] = time.monotonic):
        self.store, self.intervals, self.clock = store, intervals or Intervals(), clock
        self.last: dict[str, float] = {}
        self.errors: list[tuple[str, str, Exception]] = []
        self._stop = threading.Event()

    def tick(self) -> list[str]:
        """Runs the due tasks once, in the order refresh, flush, merge, retention; gives their names."""
        now, did = self.clock(), []
        for f in fields(Intervals):
            task = f.name
            if now - self.last.get(task, float("-inf")) < getattr(self.intervals, task):
                continue
            self.last[task] = now
            did.append(task)
            for name in self.store.indexes():
                try:
                    self._run(task, name)
                except Exception as e:
                    self.errors.append((task, name, e))
        return did

    def _run(self, task: str, name: str) -> None:
        from ..sources.store import Index

        index = Index(self.store, name)
        if task == "refresh":
            index.refresh()
        elif task == "flush":
            index.flush()
        elif task == "merge":
            if plan := index.plan_merge():
                index._fold(plan)
        elif index.settings.retention_secs is not None:
            index.evict()

    def start(self) -> threading.Thread:
        """Ticks in the background until ``stop``."""

        def loop() -> None:
            while not self._stop.wait(min(getattr(self.intervals, f.name) for f in fields(Intervals))):
                self.tick()

        thread = threading.Thread(target=loop, daemon=True, name="skerry-maintenance")
        thread.start()
        return thread

    def stop(self) -> None:
        self._stop.set()
