"""Counters of a query by phase, and a CSV file that collects them."""

from __future__ import annotations

import csv
import os
import time

from pyspark.sql import DataFrame

PHASES = ("analysis", "optimization", "planning")


def phases(df: DataFrame) -> dict[str, float]:
    """Seconds that Spark took to analyse, optimize and plan `df`, and to run it without keeping rows.
    The run plans once more, which its seconds include."""
    execution = df._jdf.queryExecution()
    execution.executedPlan()
    known = execution.tracker().phases()
    out = {p: known.apply(p).durationMs() / 1000 if known.contains(p) else 0.0 for p in PHASES}
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return out | {"execution": round(time.perf_counter() - began, 3)}


def append_csv(path: str, name: str, seconds: dict[str, float]) -> None:
    """One row of counters under a header that the first row writes; `path` is the driver's own."""
    new = not os.path.exists(path)
    with open(path, "a", newline="") as f:
        out = csv.writer(f)
        if new:
            out.writerow(["query", *seconds])
        out.writerow([name, *seconds.values()])
