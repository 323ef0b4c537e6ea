"""Job state over a stream of events: batch and stream give the same states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import first_filled

#: What each type of event does to a job.
MOVES = {"signup": "queued", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}


def statuses(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type) with the status that each one sets."""
    move = F.create_map(*[F.lit(x) for kv in MOVES.items() for x in kv])
    return events.select("event_id", "ts", "user_id", first_filled(F.element_at(move, F.col("event_type")), F.lit("queued")).alias("status"))


def batch_states(events: DataFrame) -> DataFrame:
    """The last status of each job, with its errors and events so far."""
    s = statuses(events)
    last = F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id")).alias("last")
    grouped = s.groupBy("user_id").agg(last, F.count_if(F.col("status") == "failed").alias("errors"), F.count(F.lit(1)).alias("n_events"))
    return grouped.select("user_id", "last.status", "last.ts", "last.event_id", "errors", "n_events")


def stream_states(events: DataFrame) -> DataFrame:
    """The same over a stream, in update mode: each micro-batch gives the jobs that it touched. State is one small row per job, kept by Spark's own aggregation."""
    return batch_states(events)


def progress_stream(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts of each status per window of event time; events later than the watermark are dropped."""
    s = statuses(events).withWatermark("ts", late)
    return s.groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("n"))
