"""A run's counts and times: measured as rows pass, without a second scan."""

from __future__ import annotations

import json
import logging
import resource
import threading
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("recordflow")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame, and an observation of its rows, to be read after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("n_rows")), seen


@dataclass
class Report:
    """Counts and durations by name."""

    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    findings: dict[str, dict] = field(default_factory=dict)

    def timed(self, name: str):
        report = self

        class Timer:
            def __enter__(self):
                self.began = time.perf_counter()

            def __exit__(self, *_):
                report.seconds[name] = round(time.perf_counter() - self.began, 3)
                log.info("%s: %.3f s", name, report.seconds[name])

        return Timer()

    def sorted_rows(self, before: int, after: int) -> None:
        self.counts |= {"n_input": before, "n_output": after, "duplicates_removed": before - after}

    def as_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass
class Monitor:
    """Notes, while a run lasts, the memory that executors use for blocks, the driver's resident memory, and tasks at work."""

    spark: SparkSession
    interval: float
    samples: list[dict[str, float]] = field(default_factory=list)

    def __enter__(self) -> Monitor:
        self._stop, self._began = threading.Event(), time.perf_counter()
        self._thread = threading.Thread(target=self._watch, daemon=True) if self.interval > 0 else None
        if self._thread:
            self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
            self.sample()

    def _watch(self) -> None:
        while not self._stop.wait(self.interval):
            self.sample()

    def sample(self) -> None:
        sc = self.spark.sparkContext
        status, tracker = sc._jsc.sc().getExecutorMemoryStatus().values().iterator(), sc.statusTracker()
        used = 0
        while status.hasNext():
            both = status.next()
            used += both._1() - both._2()  # most for blocks, and what is left of it
        stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
        heap = sc._jvm.java.lang.Runtime.getRuntime()
        self.samples.append({"seconds": round(time.perf_counter() - self._began, 3), "block_bytes": used, "driver_heap_bytes": heap.totalMemory() - heap.freeMemory(), "driver_python_kb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, "active_tasks": sum(s.numActiveTasks for s in stages), "completed_tasks": sum(s.numCompletedTasks for s in stages)})

    def summary(self) -> dict[str, float]:
        """The number of samples, and the most of each value."""
        return {"n_samples": len(self.samples)} | {f"most_{k}": max(s[k] for s in self.samples) for k in self.samples[0]}
