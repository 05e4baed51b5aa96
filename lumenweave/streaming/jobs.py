"""Status streams of jobs: newest generation a key, windowed counts with late data bounded, and a sequential queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "loading", "aligning", "drizzling", "saving", "succeeded", "failed", "cancelled")


def status_stream(spark, folder: str, schema) -> DataFrame:
    """Job events landing as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, ts: str = "ts", status: str = "status", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by status and window. In append and update mode a window's state is dropped behind the watermark; in complete mode it never is."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), status).agg(F.count("*").alias("jobs")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), status, "jobs"
    )


def newest(events: DataFrame, key: str, generation: str, *values: str) -> DataFrame:
    """Latest wins: for each key the values of the greatest generation; older results that arrive later change nothing.

    The state is one row a key, kept by the aggregate itself, in batch and in a stream (update mode) alike.
    """
    return events.groupBy(key).agg(F.max_by(F.struct(generation, *values), generation).alias("e")).select(key, "e.*")


def run_queue(jobs: DataFrame, execute: Callable[[object], str], key: str = "job_id") -> list[tuple]:
    """Run jobs in order, one at a time; a failed one doesn't stop the rest. The queue is a person's, and so is short."""
    out = []
    for job in jobs.orderBy(key).toLocalIterator():
        try:
            out.append((job[key], "succeeded", execute(job)))
        except Exception as e:  # noqa: BLE001  one bad job is that job's result
            out.append((job[key], "failed", str(e)))
    return out


def run_in_group(spark, group: str, action: Callable[[], object]):
    """Run an action whose Spark jobs ``spark.sparkContext.cancelJobGroup(group)`` cancels."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def run_steps(steps: list[tuple[str, Callable[[], object]]], progress: Callable[[str, int, int], None], cancelled: Callable[[], bool] = lambda: False) -> list:
    """Run named steps in order and tell before and behind each how many are done; stops, with what is done, when ``cancelled``."""
    out: list = []
    for name, step in steps:
        if cancelled():
            break
        progress(name, len(out), len(steps))
        out.append(step())
        progress(name, len(out), len(steps))
    return out
