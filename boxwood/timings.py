"""Wall-clock stamps of the phases of a build, and the jobs and tasks that Spark ran in each."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_GROUP = ("spark.jobGroup.id", "spark.job.description")


class Timings:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: list[tuple[int | None, str, int, int, int, int]] = []

    @contextmanager
    def phase(self, name: str, level: int | None = None) -> Iterator[None]:
        """Stamps what is done within, whose jobs are a job group; the caller's group comes back afterwards."""
        sc, group = self.spark.sparkContext, f"{name}-{uuid.uuid4().hex}"
        before = [sc.getLocalProperty(p) for p in _GROUP]
        sc.setJobGroup(group, name if level is None else f"{name} {level}")
        start = time.perf_counter_ns() // 1000
        try:
            yield
        finally:
            end = time.perf_counter_ns() // 1000
            for p, value in zip(_GROUP, before, strict=True):
                sc.setLocalProperty(p, value)
            self.rows.append((level, name, start, end, *self._ran(group)))

    def _ran(self, group: str) -> tuple[int, int]:
        """Jobs and completed tasks of a group."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(group)
        stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        return len(jobs), sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))

    def table(self) -> DataFrame:
        """level, phase, start_us, end_us, jobs, tasks."""
        return self.spark.createDataFrame(self.rows, "level int, phase string, start_us bigint, end_us bigint, jobs int, tasks int")

    def report(self) -> DataFrame:
        """phase, times, total_us, mean_us: the averages over levels."""
        took = F.col("end_us") - F.col("start_us")
        return self.table().groupBy("phase").agg(F.count("*").alias("times"), F.sum(took).alias("total_us"), F.avg(took).alias("mean_us")).orderBy("phase")

    def csv_row(self, max_depth: int, *stamps: int) -> str:
        """stamps (threads and those around the build), then each phase's, empty where it didn't take place; of a phase that took place more than once, the first start and the last end."""
        spans: dict[str, tuple[int, int]] = {}
        for level, name, start, end, *_ in self.rows:
            key = f"{name}_{level}" if name in LEVEL_PHASES else name
            spans[key] = (min(start, spans.get(key, (start,))[0]), end)
        return ",".join(map(str, [*stamps, *(x for key in _phases(max_depth) for x in spans.get(key, ("", "")))]))


#: The names of the columns before those of the phases, and of the phases of a level.
CSV_COLUMNS = ("Threads", "Start time", "Mesh load finish time", "Build start time", "Build finish time")
LEVEL_PHASES = ("findBestPlane", "newGen", "classifyTriangles")


def _phases(max_depth: int) -> list[str]:
    return ["init_extent", *(f"{name}_{level}" for name in LEVEL_PHASES for level in range(max_depth)), "finish", "fill"]


def csv_header(max_depth: int) -> str:
    return ",".join([*CSV_COLUMNS, *(f"{name}_{edge}" for name in _phases(max_depth) for edge in ("start", "end"))])
