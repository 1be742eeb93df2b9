"""Job event analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Allowed next states.
ALLOWED = {
    "uploaded": ("queued",),
    "queued": ("processing", "cancelled"),
    "processing": ("processing", "completed", "failed", "cancelled"),
    "completed": (), "failed": (), "cancelled": (),
}
ACTIVE = ("queued", "processing")
SLICE = "date_trunc('DAY', updated_at)"


def allowed_sql(a: str = "previous", b: str = "status") -> str:
    return "(" + " OR ".join(
        f"({a} = '{s}' AND {b} IN ({', '.join(repr(n) for n in nexts)}))" for s, nexts in ALLOWED.items() if nexts
    ) + ")"


def transitions(events: DataFrame) -> DataFrame:
    """Each event with the state before it and whether that step is allowed.

    ``events``: job_id, status, updated_at, event_id.  A job is cut into days; the last
    state of the day before is carried in, so one very long job does not fill a task.
    """
    key = F.struct("updated_at", "event_id")
    ev = events.withColumn("_day", F.expr(SLICE))
    w = Window.partitionBy("job_id", "_day").orderBy("updated_at", "event_id")
    last = ev.groupBy("job_id", "_day").agg(F.max_by("status", key).alias("_last"))
    wd = Window.partitionBy("job_id").orderBy("_day")
    carry = last.select("job_id", "_day", F.lag("_last").over(wd).alias("_carry"))
    return ev.withColumn("_in", F.lag("status").over(w)).join(carry, ["job_id", "_day"]).withColumn(
        "previous", F.coalesce("_in", "_carry")
    ).withColumn("valid", F.expr(f"previous IS NULL OR coalesce({allowed_sql()}, false)")).drop("_day", "_in", "_carry")


def latest(events: DataFrame) -> DataFrame:
    """Last state, first and last time and duration of every job; stage and progress of the last
    event, error and document as last given, where ``events`` has them."""
    key = F.struct("updated_at", "event_id")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    last = [F.max_by(c, key).alias(c) for c in ("current_stage", "progress") if c in events.columns]
    kept = [F.max_by(c, F.when(given(c), key)).alias(c) for c in ("error", "document_id") if c in events.columns]
    return events.groupBy("job_id").agg(
        F.max_by("status", key).alias("status"), *last, *kept,
        F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
        F.count("*").alias("events"),
    ).withColumn("duration_s", F.expr("timestampdiff(MICROSECOND, created_at, updated_at) / 1000000D"))


def active_conflicts(jobs: DataFrame) -> DataFrame:
    """Uploads with more than one queued or processing job."""
    return jobs.where(F.col("status").isin(*ACTIVE)).groupBy("upload_id").agg(
        F.count("*").alias("active_jobs"), F.min("job_id").alias("first_job")
    ).where("active_jobs > 1")
