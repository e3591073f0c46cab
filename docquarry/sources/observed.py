"""Counts, failures and rates of a run, taken from the run itself.

Each stage's rows are counted where they pass, by metrics that travel with the job; no stage is run a
second time to be counted.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

METRICS = "stage string, rows long, failures long, seconds double, rows_per_second double"


class ObservedRun:
    """Stages of one job: mark each with ``stage``, run the job by ``run``, then read ``metrics``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stages, self.seconds = spark, {}, 0.0

    def stage(self, df: DataFrame, name: str, failed: Column | None = None) -> DataFrame:
        """Count the rows that pass here, and those for which ``failed`` is true. Names must differ.

        A stage that the job reads twice is counted twice; mark stages of one straight line.
        """
        if name in self.stages:
            raise ValueError(f"stage {name} is there already")
        self.stages[name] = Observation()
        failures = F.count_if(F.lit(False) if failed is None else failed)
        return df.observe(self.stages[name], F.count(F.lit(1)).alias("rows"), failures.alias("failures"))

    def run(self, action: Callable[[], object]) -> object:
        """Run the job that passes all stages and take its time."""
        start = time.monotonic()
        result = action()
        self.seconds = time.monotonic() - start
        return result

    def metrics(self) -> DataFrame:
        """A row per stage, in order of marking; rates are over the whole run."""
        rows = []
        for name, observed in self.stages.items():
            found = observed.get
            rate = found["rows"] / self.seconds if self.seconds else None
            rows.append((name, found["rows"], found["failures"], self.seconds, rate))
        return self.spark.createDataFrame(rows, METRICS).coalesce(1)
