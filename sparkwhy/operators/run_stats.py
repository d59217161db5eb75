"""Timers, counters and parameters of a run."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class RunStats:
    timers: dict[str, float] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)
    graph_times: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def timed(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.timers[name] = self.timers.get(name, 0.0) + time.perf_counter() - start

    def add(self, name: str, n: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + n

    def reset(self) -> None:
        for part in (self.timers, self.counters, self.params, self.graph_times):
            part.clear()

    def total(self) -> float:
        return sum(self.timers.values())

    def report(self) -> str:
        parts = [f"{k}: {v:.3f} s" for k, v in sorted(self.timers.items())] + [f"{k}: {v}" for k, v in sorted(self.counters.items())]
        return "\n".join([*parts, f"total: {self.total():.3f} s"])

    def rows(self, spark: SparkSession, description: str) -> DataFrame:
        """(exp_desc, kind, name, value) of everything recorded, values as text."""
        found = [(description, k, n, str(v)) for k, part in (("timer", self.timers), ("counter", self.counters), ("param", self.params)) for n, v in part.items()]
        return spark.createDataFrame([*found, (description, "timer", "total", str(self.total()))], "exp_desc string, kind string, name string, value string")

    def graph_rows(self, spark: SparkSession, description: str) -> DataFrame:
        """(exp_desc, jg, timecost) of every join graph."""
        return spark.createDataFrame([(description, g, float(t)) for g, t in self.graph_times.items()], "exp_desc string, jg string, timecost double")
