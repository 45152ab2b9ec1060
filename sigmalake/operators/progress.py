"""What a job has done, without a job of its own: metrics of the pass that does the work, and tasks while it runs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df``, whose first action fills the observation with aggregates over its rows: ``.get`` waits for them."""
    seen = Observation(f"seen-{uuid.uuid4().hex}")
    return df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), seen


@contextmanager
def reported(spark: SparkSession, label: str, say: Callable[[str], None], every: float = 5.0):
    """While the block runs, ``say`` hears every some seconds how many tasks of its running stages are done."""
    sc, group, over = spark.sparkContext, f"{label}-{uuid.uuid4().hex}", threading.Event()
    tracker, began = sc.statusTracker(), time.monotonic()

    def watch() -> None:
        while not over.wait(every):
            done = total = 0
            for job in tracker.getJobIdsForGroup(group):
                info = tracker.getJobInfo(job)
                for stage in map(tracker.getStageInfo, info.stageIds if info else ()):
                    if stage:
                        done, total = done + stage.numCompletedTasks, total + stage.numTasks
            say(f"{label}: {done} of {total} tasks, {time.monotonic() - began:.0f} s")

    watcher = threading.Thread(target=watch, daemon=True)
    sc.setJobGroup(group, label)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
