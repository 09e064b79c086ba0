"""Counters of statements, and a health report of the session."""

from __future__ import annotations

import json
import time
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Metrics:
    def __init__(self):
        self.statements: Counter[str] = Counter()
        self.errors: Counter[str] = Counter()
        self.seconds: Counter[str] = Counter()
        self.started = time.time()

    @contextmanager
    def measure(self, kind: str):
        began = time.perf_counter()
        try:
            yield
        except Exception:
            self.errors[kind] += 1
            raise
        finally:
            self.statements[kind] += 1
            self.seconds[kind] += time.perf_counter() - began

    def health(self, spark: SparkSession, warn: float = 0.7, bad: float = 0.9) -> str:
        """ok, warning or bad by the share of storage memory in use."""
        status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
        it, most, left = status.values().iterator(), 0, 0
        while it.hasNext():
            pair = it.next()
            most, left = most + pair._1(), left + pair._2()
        used = 1 - left / most if most else 0.0
        return "bad" if used > bad else "warning" if used > warn else "ok"

    def as_dict(self) -> dict:
        return {"uptime_s": time.time() - self.started, "statements": dict(self.statements), "errors": dict(self.errors), "seconds": dict(self.seconds)}

    def dump(self, form: str = "json") -> str:
        if form == "json":
            return json.dumps(self.as_dict(), sort_keys=True)
        return "\n".join(f"{k} {n} {self.seconds[k]:.6f}" for k, n in sorted(self.statements.items()))
