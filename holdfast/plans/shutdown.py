"""Stopping on request: the first signal ends the run after its step, the third cancels the step too."""

from __future__ import annotations

import signal

from pyspark.sql import SparkSession

FORCE_AFTER = 3


class Shutdown:
    """Counts interrupts. A finished step is always saved, so a stopped run resumes."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.count, self._before = spark, 0, {}

    @property
    def requested(self) -> bool:
        return self.count > 0

    @property
    def forced(self) -> bool:
        return self.count >= FORCE_AFTER

    def request(self, *_: object) -> None:
        self.count += 1
        if self.forced and self.spark is not None:
            self.spark.sparkContext.cancelAllJobs()

    def __enter__(self) -> Shutdown:
        for s in (signal.SIGINT, signal.SIGTERM):
            self._before[s] = signal.signal(s, self.request)
        return self

    def __exit__(self, *_: object) -> None:
        for s, handler in self._before.items():
            signal.signal(s, handler)
